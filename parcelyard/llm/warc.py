"""WARC files: written with revisit records for repeated payloads, read by a reader that salvages damaged files.

A file is a series of gzip members of one record each (WARC/1.1), or of plain records. Reading takes a byte
range of a file: it starts at the first record at or after the range's start and ends with the record that
begins before its end, so large files are shared among tasks and read in pieces of ``PIECE`` bytes.

Every record is checked: gzip checksum, version line, headers, Content-Length, the end of the block, and
block and payload digests. After a failed check the reader searches for the next gzip member whose content
begins with a version line, or the next version line of a plain record, goes on there, and reports the bytes
between as a quarantined gap.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import new_path, open_shared, stored

PIECE = 1 << 20
SPLIT = 64 << 20
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_STEP = 64 << 10  #: members are inflated, and the end of a plain record's headers is searched, in steps of so many bytes


@dataclass
class Record:
    start: int
    end: int
    headers: dict[str, str]
    block: bytes


@dataclass
class Gap:
    start: int
    end: int
    reason: str


class Damaged(Exception):
    pass


@dataclass
class Source:
    """Bytes of a file by position, read in pieces; what is held is read on from, so that each byte is read about once."""

    file: object
    size: int
    held: bytes = b""
    at: int = 0

    def get(self, start: int, n: int) -> bytes:
        """The n bytes from ``start`` on, or fewer at the end of the file."""
        end = min(start + n, self.size)
        if not self.at <= start <= self.at + len(self.held):
            self.held, self.at = b"", start
        reached = self.at + len(self.held)
        if end > reached:
            self.file.seek(reached)
            more = self.file.read(min(max(end - reached, PIECE), self.size - reached))
            self.held, self.at = self.held[start - self.at :] + more, start
        return self.held[start - self.at : end - self.at]


def parse(body: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one whole record, all checks made."""
    if not VERSION.match(body):
        raise Damaged("no version line")
    end = body.find(b"\r\n\r\n")
    if end < 0:
        raise Damaged("headers don't end")
    headers = {}
    for line in body[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("bad header line")
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not headers.get("content-length", "").isdigit():
        raise Damaged("no content length")
    n = int(headers["content-length"])
    block = body[end + 4 : end + 4 + n]
    if len(block) < n:
        raise Damaged("block is cut short")
    if body[end + 4 + n :] != b"\r\n\r\n":
        raise Damaged("block does not end where it should")
    want = headers.get("warc-block-digest")
    if want and want.startswith("sha256:") and hashlib.sha256(block).hexdigest() != want[7:]:
        raise Damaged("block digest differs")
    want = headers.get("warc-payload-digest")
    if want and want.startswith("sha256:") and headers.get("warc-type") != "revisit" and hashlib.sha256(payload_of(headers, block)).hexdigest() != want[7:]:
        raise Damaged("payload digest differs")
    return headers, block


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The body of the HTTP message in a block, or the block itself."""
    if headers.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def _member(source: Source, start: int) -> tuple[bytes, int]:
    """Content and end of the gzip member at ``start``."""
    inflate, out, at = zlib.decompressobj(31), [], start
    while not inflate.eof:
        if at >= source.size:
            raise Damaged("member is cut short")
        piece = source.get(at, _STEP)
        try:
            out.append(inflate.decompress(piece))
        except zlib.error as e:
            raise Damaged(f"gzip: {e}") from None
        at += len(piece)
    return b"".join(out), at - len(inflate.unused_data)


def _plain(source: Source, start: int) -> tuple[bytes, int]:
    """Content and end of the plain record at ``start``."""
    at = start
    while (k := (piece := source.get(at, _STEP)).find(b"\r\n\r\n")) < 0:
        if at + len(piece) >= source.size:
            raise Damaged("headers don't end")
        at += len(piece) - 3  # the blank line may lie across two pieces
    end = at + k - start
    m = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)\s*\r\n", source.get(start, end + 2))
    if not m:
        raise Damaged("no content length")
    n = end + 4 + int(m[1]) + 4
    if start + n > source.size:
        raise Damaged("block is cut short")
    return source.get(start, n), start + n


def _begins(source: Source, at: int) -> bool:
    """Whether a record can begin here: a version line, or a gzip member, with a header of any length, whose content begins with one."""
    head = source.get(at, 4096)
    if VERSION.match(head):
        return True
    if not head.startswith(MAGIC):
        return False
    inflate, out = zlib.decompressobj(31), b""
    try:
        while len(out) < 10 and head and not inflate.eof:
            out += inflate.decompress(head, 16 - len(out))
            if len(out) < 10:
                at += len(head)
                head = source.get(at, _STEP)
    except zlib.error:
        return False
    return bool(VERSION.match(out))


def _search(source: Source, at: int, end: int) -> int:
    """The next position before ``end`` where a record can begin, or ``end``."""
    mark = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
    while at < end:
        piece = source.get(at, PIECE)
        for m in mark.finditer(piece):
            if at + m.start() >= end:
                return end
            if _begins(source, at + m.start()):
                return at + m.start()
        at += max(1, len(piece) - 16)
    return end


def salvage(file, size: int, start: int = 0, end: int | None = None) -> Iterator[Record | Gap]:
    """Records that begin in [start, end) of a file, and the gaps between them.

    A range that starts inside a record skips to the next one without a report, since the range before
    reads that record or reports it. Headers and blocks may have any length; one record at a time is in memory.
    """
    source, end = Source(file, size), size if end is None else min(end, size)
    at = start if start == 0 else _search(source, start, end)
    while at < end:
        gap, reason = at, ""
        try:
            if not _begins(source, at):
                raise Damaged("no record begins here")
            body, after = _member(source, at) if source.get(at, 3) == MAGIC else _plain(source, at)
            headers, block = parse(body)
            yield Record(at, after, headers, block)
            at = after
            continue
        except Damaged as e:
            reason = str(e)
        at = _search(source, at + 1, size if at + 1 >= end else end)
        if at >= end and end < size:  # the gap goes on up to the first record of the next range
            at = _search(source, at, size)
        yield Gap(gap, at, reason)


def record(kind: str, record_id: str, headers: dict[str, str], block: bytes, level: int = 1) -> bytes:
    """A record as a gzip member (plain if level is None)."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 2000-01-01T00:00:00Z", *(f"{k}: {v}" for k, v in headers.items()), f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    body = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    if level is None:
        return body
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(body) + pack.flush()


FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("n_records", T.LongType())])
READ = T.StructType([T.StructField(n, t) for n, t in (("path", T.StringType()), ("start", T.LongType()), ("end", T.LongType()), ("gap", T.StringType()), ("key", T.StringType()), ("record_type", T.StringType()), ("payload_digest", T.StringType()), ("payload_bytes", T.LongType()), ("refers_to", T.StringType()), ("url", T.StringType()), ("payload", T.BinaryType()))])


def _write(folder: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_shared(folder)
        context = TaskContext.get()
        name, k, out, n, size = "", 0, None, 0, 0

        def row() -> pa.RecordBatch:
            out.close()
            return pa.record_batch([pa.array([x]) for x in (f"{folder}/{name}", size, n)], FILES.names)

        for batch in batches:
            for key, url, html, digest, first in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name, n, size = f"part-{context.partitionId():06d}-{k:06d}-{context.taskAttemptId()}.warc.gz", 0, 0
                    out, k = fs.open_output_stream(f"{root}/{name}", compression=None), k + 1
                payload = (html or "").encode()
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                target = "".join(c for c in url or "" if c.isprintable())
                name_of = lambda x: "urn:page-without-id" if x is None else f"urn:page:{quote(x, safe='')}"
                headers = {"Content-Type": "application/http; msgtype=response", "WARC-Target-URI": target, "WARC-Payload-Digest": f"sha256:{digest}"}
                if first is None:
                    body = record("response", name_of(key), headers, http + payload)
                else:
                    headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<{name_of(first)}>"}
                    body = record("revisit", name_of(key), headers, http)
                out.write(body)
                n, size = n + 1, size + len(body)
                if size >= most:
                    yield row()
                    out = None
        if out is not None:
            yield row()

    return run


def write_warc(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, folder: str | None = None, file_bytes: int = 1 << 30) -> DataFrame:
    """Write a record for each row; returns path, bytes and n_records of the files.

    Of rows with equal payloads (UTF-8 of the html, null is empty) of at least ``least`` bytes the one with
    the smallest id is the response, and all others revisit it; shorter payloads are all responses. Among rows
    that repeat that smallest id, each is a response. Rows with a null id are responses. Ids may be of any type and
    hold any characters, urls and texts may be null or of any length; characters of a url that can't be printed are left
    out of its record. Other columns don't matter; no rows make no files.

    Who revisits whom is found out with ids and digests only. The pages are then joined with the revisits: without
    moving the pages while these fit the session's broadcast limit, beyond it with one shuffle of all pages.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("key"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.encode("html", "utf-8"), 256))
    ids = stored(rows.where(F.octet_length("html") >= least).select("key", "digest"), "digests")
    first = stored(ids.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "repeated")
    revisits = ids.join(first, "digest").where("key <> first").select(F.col("key").alias("k"), F.col("digest").alias("d"), "first").distinct()
    both = rows.join(stored(revisits, "revisits"), (F.col("key") == F.col("k")) & (F.col("digest") == F.col("d")), "left").select(F.col("key").cast("string").alias("key"), "url", "html", "digest", F.col("first").cast("string").alias("first"))
    folder = folder or new_path(pages.sparkSession, "warc")
    fs, root = open_shared(folder)
    fs.create_dir(root, recursive=True)
    return stored(both.mapInArrow(_write(folder, file_bytes), FILES), "files")


def _read(keep_payload: bool, strict: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, t) for n, t in zip(READ.names, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()))])
        for batch in batches:
            for path, size, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                fs, name = open_shared(path)
                rows, held = [], 0
                with fs.open_input_file(name) as file:
                    for x in salvage(file, size, start, end):
                        if isinstance(x, Gap):
                            if strict:
                                raise ValueError(f"{path}: bytes {x.start} to {x.end} are no record: {x.reason}")
                            rows.append((path, x.start, x.end, x.reason, None, None, None, None, None, None, None))
                        else:
                            rows.append((path, x.start, x.end, None, *_fields(x), payload_of(x.headers, x.block) if keep_payload else None))
                            held += len(rows[-1][9] or "") + (len(x.block) if keep_payload else 0)
                        if len(rows) >= 2000 or held > 8 << 20:
                            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _fields(x: Record) -> tuple:
    h = x.headers
    digest = h.get("warc-payload-digest", "").partition(":")[2] or hashlib.sha256(payload_of(h, x.block)).hexdigest()
    size = len(payload_of(h, x.block))
    if h.get("warc-type") == "revisit":  # the payload is not here; the HTTP headers say how long it is
        m = re.search(rb"(?i)content-length:\s*(\d+)", x.block)
        size = int(m[1]) if m else None
    return _key(h.get("warc-record-id")), h.get("warc-type"), digest, size, _key(h.get("warc-refers-to")), h.get("warc-target-uri")


def _key(name: str | None) -> str | None:
    """The id of a page from the name of a record; null for a page without one. Names that others gave stay as they are."""
    name = (name or "").strip("<>")
    if not name or name == "urn:page-without-id":
        return None
    return unquote(name[len("urn:page:") :]) if name.startswith("urn:page:") else name


def read_warc(files: DataFrame, *, split: int = SPLIT, keep_payload: bool = True, strict: bool = False) -> DataFrame:
    """Records and gaps of files (path, bytes): a gap has its reason in ``gap`` and no record fields; rows of records have none.

    ``key`` and ``refers_to`` are the ids that :func:`write_warc` was given, as text, or the names of records of other writers.
    Empty files give no rows. Every byte of a file is in a record or in a gap. If ``strict``, the first gap is an error.
    """
    n = F.greatest(F.lit(1), F.ceil(F.col("bytes") / split)).cast("int")
    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    ranges = ranges.select("path", "bytes", (F.col("k").cast("long") * split).alias("start"), F.least("bytes", (F.col("k").cast("long") + 1) * split).alias("end"))
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(parts).mapInArrow(_read(keep_payload, strict), READ)
