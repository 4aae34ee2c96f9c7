"""Command line: version, create, extract, list and test."""

from __future__ import annotations

import argparse
import sys

from . import __version__


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="parcelyard")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    for name in ("create", "extract", "list", "test"):
        c = sub.add_parser(name)
        c.add_argument("archive")
        if name in ("create", "extract"):
            c.add_argument("paths", nargs="*")
        c.add_argument("--password")
        c.add_argument("--threads", type=int, default=0)
        c.add_argument("--memory-mb", type=int, default=2048)
        c.add_argument("--chunk-kb", type=int, default=1024)
        for flag in ("--parallel-read", "--no-parallel-read"):
            c.add_argument(flag, action="store_true", help="accepted; Spark reads in parallel anyway")
        group = c.add_mutually_exclusive_group()
        for profile in ("store", "deflate", "fast", "balanced", "small", "max"):
            group.add_argument(f"--{profile}", dest="profile", action="store_const", const={"deflate": "fast", "max": "maximum"}.get(profile, profile))
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(__version__)
        return 0
    from pyspark.sql import SparkSession

    from .plans.jobs import Operation, Options, Profile, Request, Source, Status, execute

    spark = SparkSession.builder.appName("parcelyard").getOrCreate()
    options = Options(chunk_bytes=args.chunk_kb * 1024, memory_mb=args.memory_mb, threads=args.threads, password=args.password)
    if args.command == "create":
        request = Request(Operation.CREATE, tuple(Source(p) for p in args.paths), args.archive, Profile(args.profile or "fast"), options)
    else:
        request = Request(Operation(args.command), (Source(args.archive),), (getattr(args, "paths", None) or [None])[0], options=options)
    result = execute(spark, request)
    print(result.message, file=sys.stdout if result.status is Status.OK else sys.stderr)
    if result.rows is not None and args.command == "list":
        for row in result.rows.select("line").toLocalIterator():
            print(row.line)
    return 0 if result.status is Status.OK else 1


if __name__ == "__main__":
    sys.exit(main())
