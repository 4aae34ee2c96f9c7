"""Requests, their checks, and their execution with progress, diagnostics and cancelling."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import archive as A
from ..ship import ship

log = logging.getLogger("parcelyard")


class Operation(str, Enum):
    CREATE, EXTRACT, LIST, TEST = "create", "extract", "list", "test"


class Profile(str, Enum):
    STORE, FAST, BALANCED, SMALL, MAXIMUM = "store", "fast", "balanced", "small", "maximum"


class Status(str, Enum):
    OK, CANCELLED, INVALID_JOB, IO_ERROR, NOT_FOUND, UNSUPPORTED = "ok", "cancelled", "invalid_job", "io_error", "not_found", "unsupported"


class Encryption(str, Enum):
    NONE, TRADITIONAL = "none", "zip-traditional"


class Phase(str, Enum):
    STARTED, SCANNING, PROCESSING, WRITING, COMPLETED = "Started", "ScanningInputs", "ProcessingItems", "WritingOutput", "Completed"


@dataclass(frozen=True)
class Options:
    chunk_bytes: int = X.MIB
    memory_mb: int = 2048
    max_in_flight: int = 0
    threads: int = 0
    encryption: Encryption | None = None
    password: str | None = None

    def resolved(self) -> Encryption:
        """A password without a mode means the traditional one."""
        if self.encryption is not None:
            return self.encryption
        return Encryption.TRADITIONAL if self.password else Encryption.NONE


@dataclass(frozen=True)
class Source:
    """A path of the file system, or rows (archive_path, content) under names of their own."""

    path: str | None = None
    recursive: bool = True
    archive_path: str | None = None
    rows: DataFrame | None = None


@dataclass(frozen=True)
class Request:
    operation: Operation
    sources: tuple[Source, ...] = ()
    output: str | None = None
    profile: Profile = Profile.FAST
    options: Options = field(default_factory=Options)


@dataclass(frozen=True)
class Progress:
    phase: Phase
    done_items: int = 0
    all_items: int = 0
    done_bytes: int = 0
    all_bytes: int = 0
    path: str = ""
    message: str = ""


@dataclass(frozen=True)
class Result:
    status: Status
    message: str
    rows: DataFrame | None = None


@dataclass
class Context:
    on_progress: Callable[[Progress], None] | None = None
    on_diagnostic: Callable[[str, str, str], None] | None = None
    cancelled: Callable[[], bool] | None = None

    def report(self, phase: Phase, **what) -> None:
        if self.on_progress:
            self.on_progress(Progress(phase, **what))

    def is_cancelled(self) -> bool:
        return bool(self.cancelled and self.cancelled())


class Invalid(Exception):
    def __init__(self, status: Status, message: str):
        super().__init__(message)
        self.status, self.message = status, message


def check(r: Request) -> None:
    if not r.sources or any((s.path is None) == (s.rows is None) for s in r.sources):
        raise Invalid(Status.INVALID_JOB, "invalid archive request")
    if r.operation is Operation.CREATE and not r.output:
        raise Invalid(Status.INVALID_JOB, "invalid archive request")
    if r.operation is not Operation.CREATE and (len(r.sources) != 1 or r.sources[0].path is None):
        raise Invalid(Status.INVALID_JOB, "invalid archive request")
    if r.options.resolved() is Encryption.TRADITIONAL and not r.options.password:
        raise Invalid(Status.INVALID_JOB, "zip password is required when encryption is enabled")


def pipeline_plan(options: Options, cores: int) -> dict[str, int]:
    """Chunk size, chunks in flight and threads that a single machine would use; Spark's own are its partitions."""
    chunk = max(64 * X.KIB, options.chunk_bytes)
    fits = options.memory_mb * X.MIB // (2 * chunk)
    flight = 32 if options.memory_mb == 0 else max(1, min(128, fits))
    if options.max_in_flight:
        flight = max(1, min(128, options.max_in_flight))
    return {"chunk": chunk, "inflight": flight, "reader_threads": 1, "compressor_threads": options.threads or max(1, (cores or 6) - 2), "writer_threads": 1}


def collect(spark: SparkSession, r: Request) -> DataFrame:
    """Entries of all sources, in their order: files by path, and directories with a slash at the end."""
    out: DataFrame | None = None
    for k, s in enumerate(r.sources):
        if s.rows is not None:
            rows = A.collect_entries(s.rows, archive=F.lit("archive"))
        else:
            path = Path(s.path)
            if not path.exists():
                raise Invalid(Status.NOT_FOUND, f"input not found: {s.path}")
            if path.is_file():
                files = spark.read.format("binaryFile").load(str(path))
                rows = files.select(F.lit(s.archive_path or path.name).alias("archive_path"), "content")
                rows = A.collect_entries(rows, archive=F.lit("archive"))
            elif path.is_dir():
                root = s.archive_path or path.name
                folders = [f"{root}/"] + ([f"{root}/{p.relative_to(path).as_posix()}/" for p in sorted(path.rglob("*")) if p.is_dir()] if s.recursive else [])
                found = [p for p in (path.rglob("*") if s.recursive else path.glob("*")) if p.is_file() and not (r.output and p.resolve() == Path(r.output).resolve())]
                # Spark's reader may pass over files without bytes, so those come from the walk
                names = [(x, True) for x in folders] + [(f"{root}/{p.relative_to(path).as_posix()}", False) for p in found if not p.stat().st_size]
                rows = spark.createDataFrame(names, "archive_path string, is_directory boolean")
                rows = rows.select(F.lit("archive").alias("archive"), "archive_path", "is_directory", F.lit(b"").cast("binary").alias("content"))
                if any(p.stat().st_size for p in found):
                    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(s.recursive).lower()).load(str(path)).where("length > 0")
                    base = path.resolve().as_uri().replace("file:///", "file:/")
                    files = files.where(F.col("path") != Path(r.output).resolve().as_uri().replace("file:///", "file:/")) if r.output else files
                    relative = F.concat(F.lit(root), F.substring(F.replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), F.lit("file:///"), F.lit("file:/")), len(base) + 1, 1 << 20))
                    rows = rows.unionByName(A.collect_entries(files.select(relative.alias("archive_path"), "content"), archive=F.lit("archive")))
            else:
                raise Invalid(Status.UNSUPPORTED, f"unsupported input type: {s.path}")
        rows = rows.withColumn("source_index", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    return A.placed(out, "archive", ["source_index", "archive_path"])  # by names only, contents are not put in order


def execute(spark: SparkSession, r: Request, context: Context | None = None) -> Result:
    """Run a request. Progress comes from this thread: Started, ProcessingItems, WritingOutput per entry, Completed."""
    context = context or Context()
    ship(spark)
    label = f"zip {r.operation.value}"
    try:
        check(r)
        if context.is_cancelled():
            return Result(Status.CANCELLED, f"{label} cancelled before start")
        context.report(Phase.STARTED, message=label)
        result = {Operation.CREATE: _create, Operation.EXTRACT: _extract, Operation.LIST: _list, Operation.TEST: _test}[r.operation](spark, r, context)
    except Invalid as x:
        result = Result(x.status, x.message)
    except OSError as x:
        result = Result(Status.IO_ERROR, str(x))
    if result.status is Status.OK:
        context.report(Phase.COMPLETED, message=result.message)
    elif result.status is not Status.CANCELLED:
        log.error("%s: %s", label, result.message)
        if context.on_diagnostic:
            context.on_diagnostic("Error", r.output or "", result.message)
    return result


def _create(spark: SparkSession, r: Request, context: Context) -> Result:
    entries = collect(spark, r)
    password = r.options.password if r.options.resolved() is Encryption.TRADITIONAL else None
    made = A.create_archives(entries, profile=r.profile.value, chunk=r.options.chunk_bytes, password=password, parts=r.options.threads or None).first()
    if made is None:
        raise Invalid(Status.INVALID_JOB, "no input files found")
    from ..storage import open_shared

    fs, path = open_shared(made.path)
    context.report(Phase.PROCESSING, all_items=made.n_entries, message="zip create prepared entries")
    os.makedirs(os.path.dirname(os.path.abspath(r.output)), exist_ok=True)
    with fs.open_input_file(path) as source, open(f"{r.output}.new", "wb") as out:
        while data := source.read(A.PIECE):
            if context.is_cancelled():
                out.close()
                os.unlink(f"{r.output}.new")
                return Result(Status.CANCELLED, "zip create cancelled")
            out.write(data)
    os.replace(f"{r.output}.new", r.output)  # a longer archive that was there before leaves nothing behind
    fs.delete_file(path)
    _report_entries(context, A.list_archives(_one(spark, r.output)))
    plan = pipeline_plan(r.options, os.cpu_count() or 0)
    words = " ".join(f"{k}={v}" for k, v in plan.items())
    return Result(Status.OK, f"created zip archive entries={made.n_entries} output={r.output} pipeline {words}")


def _report_entries(context: Context, listed: DataFrame) -> None:
    if not context.on_progress:
        return
    total = listed.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
    done = 0
    for k, row in enumerate(listed.orderBy("entry_index").select("name", "size").toLocalIterator()):
        done += row.size
        context.report(Phase.WRITING, done_items=k + 1, all_items=total.n, done_bytes=done, all_bytes=total.b, path=row.name)


def _one(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame([("archive", os.path.abspath(path))], "archive string, path string")


def _failed(checks: DataFrame) -> None:
    first = A.first_failure(checks).first()
    if first is not None and first.status != "ok":
        raise Invalid(Status(first.status), first.message)


def _list(spark: SparkSession, r: Request, context: Context) -> Result:
    listed = A.list_archives(_one(spark, r.sources[0].path))
    bad = listed.where("status <> 'ok'").first()
    if bad is not None:
        raise Invalid(Status(bad.status), bad.message)
    n = listed.count()
    context.report(Phase.PROCESSING, done_items=n, all_items=n)
    line = X.list_line(F.col("is_directory"), F.col("size"), F.col("packed"), F.col("method"), F.col("encrypted"), F.col("crc32"), F.col("name"))
    return Result(Status.OK, f"zip entries={n}", listed.orderBy("entry_index").withColumn("line", line))


def _test(spark: SparkSession, r: Request, context: Context) -> Result:
    checks = A.test_archives(_one(spark, r.sources[0].path), password=r.options.password)
    _failed(checks)
    n = checks.count()
    context.report(Phase.PROCESSING, done_items=n, all_items=n)
    return Result(Status.OK, f"tested zip archive files={n} status=ok", checks)


def _extract(spark: SparkSession, r: Request, context: Context) -> Result:
    path = r.sources[0].path
    root = r.output or os.path.splitext(path)[0]
    listed = A.list_archives(_one(spark, path))
    _failed(A.test_archives(_one(spark, path), password=r.options.password))  # nothing is written unless all can be
    unsafe = listed.where(X.unsafe_path(F.col("name"))).orderBy("entry_index").first()
    if unsafe is not None:
        raise Invalid(Status.INVALID_JOB, f"unsafe archive path: {unsafe.name}")
    if context.is_cancelled():
        return Result(Status.CANCELLED, "zip extract cancelled")
    os.makedirs(root, exist_ok=True)
    for row in listed.where("is_directory").select("name").toLocalIterator():
        os.makedirs(os.path.join(root, row.name), exist_ok=True)
    rows = A.extract_archives(_one(spark, path), password=r.options.password)

    def put(part) -> None:
        for row in part:
            target = os.path.join(root, X_normal(row.name))
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target, "wb") as out:
                out.write(row.content)

    X_normal = lambda name: name.replace("\\", "/")
    rows.select("name", "content").foreachPartition(put)
    n = listed.where("not is_directory").count()
    context.report(Phase.PROCESSING, done_items=0, all_items=n)
    _report_entries(context, listed.where("not is_directory"))
    return Result(Status.OK, f"extracted zip archive files={n} output={root}")
