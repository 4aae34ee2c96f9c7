"""Create, list, test and extract archives as DataFrame operations.

Creating: entries are planned with column expressions, dealt out by ranges of (archive, entry_index, chunk), and each task
writes the local records of its slice into segment files, which hold no absolute offsets. Entries of several chunks are
dealt chunk by chunk, so a large one is deflated by many tasks. Then one row per
archive, with its segments' names in order, is assembled: segments are copied in pieces and the directory,
whose offsets follow from the segments' sizes, is put behind them. An archive may be spread over any number of tasks,
and its bytes do not depend on how it was.

Reading: listing reads the end and the directory of a file only; testing and extracting deal out directory rows and read
the byte range of each entry. Failures are rows with a status and message, so the first failure of an archive is that
with the lowest entry index.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codecs
from ..functions import expressions as X
from ..sources.records import AES, DEFLATE, ENCRYPTED, HAS_DESCRIPTOR, MAX32, STORE, UTF8, ArchiveError, Entry, Ranges, descriptor, directory_record, end_records, local_header, locate, parse_directory
from ..storage import new_path, open_shared, stored

PIECE = 8 << 20


def collect_entries(files: DataFrame, *, archive: Column | None = None, path_col: str = "archive_path", content_col: str = "content", with_directories: bool = False) -> DataFrame:
    """``archive, archive_path, is_directory, content`` with normal paths; with a row for each parent directory if wanted."""
    of = F.lit("archive") if archive is None else archive
    rows = files.select(of.alias("archive"), X.normal_path(F.col(path_col)).alias("archive_path"), F.lit(False).alias("is_directory"), F.col(content_col).cast("binary").alias("content"))
    if not with_directories:
        return rows
    parts = F.split("archive_path", "/")
    parents = rows.select("archive", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda k: F.when(k < F.size(parts), F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/"))))).alias("archive_path"))
    parents = parents.where("archive_path is not null and archive_path <> '/'").distinct()
    return rows.unionByName(parents.select("archive", "archive_path", F.lit(True).alias("is_directory"), F.lit(b"").cast("binary").alias("content")))


def plan_entries(entries: DataFrame, *, profile: str = "fast", chunk: int = X.MIB, encrypt: bool = False, adaptive: bool = True) -> DataFrame:
    """Adds size, method, flag, level, chunk_size, chunk_count and execution_path. A null content is empty."""
    size = F.octet_length(F.coalesce("content", F.lit(b"").cast("binary"))).cast("long")
    rows = entries.withColumn("size", size).withColumn("profile", F.lit(profile))
    method = F.when(F.col("is_directory"), STORE).when(X.prefers_store(F.col("archive_path"), F.col("size")), STORE).otherwise(X.method_of(F.col("profile")))
    rows = rows.withColumn("method", method)
    if adaptive:
        sample = X.sample_of(F.col("content"))
        packed = F.octet_length(codecs.zip_deflate(F.when(X.adaptive_candidate(F.col("is_directory"), F.col("method"), F.col("size")), sample), F.lit(1), F.lit(0)))
        store = F.coalesce(X.looks_incompressible(F.octet_length(sample), packed, X.adaptive_threshold(F.col("profile"), F.col("size"))), F.lit(False))
        rows = rows.withColumn("method", F.when(store, STORE).otherwise(F.col("method")))
    secret = F.lit(encrypt) & ~F.col("is_directory")
    flag = F.when(F.col("is_directory"), 0).when(secret, ENCRYPTED).otherwise(HAS_DESCRIPTOR)
    flag = flag.bitwiseOR(F.when(F.octet_length("archive_path") > F.length("archive_path"), UTF8).otherwise(0))
    size_of = X.chunk_size(F.col("size"), chunk)
    return rows.withColumns({"flag": flag, "level": X.level_of(F.col("profile")), "chunk_size": size_of, "chunk_count": X.chunk_count(F.col("size"), size_of), "execution_path": X.execution_path(F.col("is_directory"), secret, F.col("method"))})


def numbered(entries: DataFrame) -> DataFrame:
    """Adds entry_index by path where the caller has none."""
    if "entry_index" in entries.columns:
        return entries
    return placed(entries.withColumn("_sum", F.crc32("content")), "archive", ["archive_path", "is_directory", "_sum"]).drop("_sum")


def placed(entries: DataFrame, of: str, order: list[str]) -> DataFrame:
    """Adds entry_index: the place of each row of ``of`` in the order of some columns, equal rows in any order.

    Only these columns are put in order, in ranges of names that are then numbered by the sizes of the ranges before; the
    rows with their contents are joined to their numbers and never sorted.
    """
    spark = entries.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = entries.groupBy(of, *order).agg(F.count("*").alias("_n"))
    names = stored(names.repartitionByRange(parts, of, *[F.col(c).asc_nulls_first() for c in order]).withColumn("_range", F.spark_partition_id()), "names")
    sums = names.groupBy(F.col(of).alias("_of"), F.col("_range").alias("_r")).agg(F.sum("_n").alias("_sum_n"))
    before = W.partitionBy("_of").orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("_of", "_r", F.coalesce(F.sum("_sum_n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy(of, "_range").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(W.unboundedPreceding, -1)
    numbers = names.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(sums, F.col(of).eqNullSafe(F.col("_of")) & (F.col("_range") == F.col("_r")))
    numbers = stored(numbers.select(F.col(of).alias("_of"), *[F.col(c).alias(f"_by{k}") for k, c in enumerate(order)], (F.col("_before") + F.col("_inside")).alias("_first"), "_n"), "numbers")
    same = F.col(of).eqNullSafe(F.col("_of"))
    for k, c in enumerate(order):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    both = entries.join(numbers, same)
    index = F.col("_first")
    if numbers.where("_n > 1").limit(1).count():  # equal names are numbered among themselves
        index = index + F.row_number().over(W.partitionBy(of, *order).orderBy(F.lit(1))) - 1
    return both.withColumn("entry_index", index.cast("long")).drop("_of", *[f"_by{k}" for k in range(len(order))], "_first", "_n")


_ENTRY = "<IHHIIIIQB"  # name length, flag, method, crc, packed, size, entry index, offset, directory
SEGMENT = "archive string, first long, chunk long, segment string, bytes long, n long, ahead long, patch long"


def _dealt(planned: DataFrame) -> DataFrame:
    """Entries as rows of at most one chunk each, so that the chunks of a large entry can go to different tasks.

    Encrypted entries are whole, since the cipher runs through an entry. All of it is built-in functions; the content
    is not among the columns that are repeated for each chunk.
    """
    body = F.coalesce("content", F.lit(b"").cast("binary"))
    whole = (F.col("flag").bitwiseAND(ENCRYPTED) != 0) | (F.col("chunk_count") <= 1)
    cut = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunk_count") - 1), lambda k: F.substring(body, (k * F.col("chunk_size") + 1).cast("int"), F.col("chunk_size").cast("int")))
    rows = planned.select(
        "archive", F.col("entry_index").cast("long").alias("entry_index"), "archive_path", "method", "level", "flag", "is_directory", F.col("size").alias("full"), F.crc32(body).alias("crc"),
        F.posexplode(F.when(whole, F.array(body)).otherwise(cut)).alias("chunk_index", "payload"), F.when(whole, F.lit(1).cast("long")).otherwise(F.col("chunk_count")).alias("chunks"),
    )
    return rows.withColumn("chunk_index", F.col("chunk_index").cast("long")).select(*_CHUNK)


_CHUNK = ("archive", "entry_index", "archive_path", "method", "level", "flag", "is_directory", "full", "crc", "chunk_index", "chunks", "payload")


def _segments(folder: str, password: str | None, seed: int | None):
    """Local records of a task's chunks, a segment for each archive, and a side file with its entries.

    A task may begin or end inside an entry. Only the first entry of a segment can have begun before it; where such an entry
    ends, its packed size is not known here, so its descriptor is left open at ``patch`` behind the ``ahead`` bytes of that entry.
    An entry that goes on in the next segment has what was packed so far in the side file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_shared(folder)
        context = TaskContext.get()
        out = side = e = None
        now = name = None
        first = chunk = at = n = ahead = k = 0
        patch, index = -1, 0

        def entered() -> None:
            """The open entry, as far as it is packed, in the side file."""
            nonlocal e, n
            if e is not None:
                side.write(struct.pack(_ENTRY, len(e.name), e.flag, e.method, e.crc, e.packed, e.size, index & MAX32, e.offset, e.directory) + e.name)
                e, n = None, n + 1

        def close() -> pa.RecordBatch:
            entered()
            out.close()
            side.close()
            return pa.record_batch([pa.array([x]) for x in (now, first, chunk, f"{folder}/{name}", at, n, ahead, patch)], [x.split()[0] for x in SEGMENT.split(", ")])

        for batch in batches:
            rows = {c: batch.column(j).to_pylist() for j, c in enumerate(_CHUNK)}
            packed = []
            for body, method, level, part, parts in zip(rows["payload"], rows["method"], rows["level"], rows["chunk_index"], rows["chunks"]):
                packed.append(codecs.deflate_chunk(body, level, part + 1 == parts) if method == DEFLATE else body)
            secret = [j for j, flag in enumerate(rows["flag"]) if flag & ENCRYPTED]
            if secret:
                for j in secret:
                    if rows["method"][j] == DEFLATE and len(packed[j]) >= len(rows["payload"][j]):
                        packed[j], rows["method"][j] = rows["payload"][j], STORE
                heads = [os.urandom(10) if seed is None else hashlib.sha256(f"{seed}/{rows['archive'][j]}/{rows['entry_index'][j]}/{rows['archive_path'][j]}/{rows['crc'][j]}".encode()).digest() for j in secret]
                for j, x in zip(secret, codecs.encrypt_all([packed[j] for j in secret], [rows["crc"][j] >> 16 for j in secret], (password or "").encode(), heads)):
                    packed[j] = x
            for archive, place, path, method, flag, is_dir, full, crc, part, parts, x in zip(*(rows[c] for c in ("archive", "entry_index", "archive_path", "method", "flag", "is_directory", "full", "crc", "chunk_index", "chunks")), packed):
                if path is None:
                    raise ArchiveError("invalid_job", f"entry {place} of archive {archive} has no path")
                if archive != now or out is None:
                    if out is not None:
                        yield close()
                    now, first, chunk, at, n, ahead, patch, k = archive, place, part, 0, 0, 0, -1, k + 1
                    name = f"segment-{context.partitionId():06d}-{k:06d}-{context.taskAttemptId()}"
                    out, side = fs.open_output_stream(f"{root}/{name}", compression=None), fs.open_output_stream(f"{root}/{name}.cd", compression=None)
                if part == 0:
                    entered()
                    e, index = Entry(path.encode(), flag, method, crc, 0, full, at, is_dir), place
                    head = local_header(Entry(e.name, flag, method, crc, len(x), full, at, is_dir))
                    out.write(head)
                    at += len(head)
                out.write(x)
                at += len(x)
                if e is None:
                    ahead += len(x)
                else:
                    e.packed += len(x)
                if full > MAX32 or (e is not None and e.packed > MAX32):
                    raise ArchiveError("unsupported", f"zip64 not implemented for file: {path}")
                if part + 1 == parts:
                    if e is None:
                        patch = at
                    tail = descriptor(e or Entry(path.encode(), flag, method, crc, 0, full, 0, is_dir))
                    out.write(tail)
                    at += len(tail)
        if out is not None:
            yield close()

    return run


def _entries_of(body: bytes) -> Iterator[Entry]:
    """The entries of a side file."""
    k = 0
    while k < len(body):
        n, flag, method, crc, packed, full, _, offset, is_dir = struct.unpack_from(_ENTRY, body, k)
        k += struct.calcsize(_ENTRY)
        yield Entry(body[k : k + n], flag, method, crc, packed, full, offset, bool(is_dir))
        k += n


def _assemble(folder: str):
    """One archive of its segments: they are copied in pieces, open descriptors are filled in, and the directory follows.

    Besides a piece, the packed size of entries that lie in several segments is held, at most one for a segment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_shared(folder)
        attempt = TaskContext.get().taskAttemptId()

        def side(segment: dict) -> bytes:
            with fs.open_input_file(open_shared(segment["segment"])[1] + ".cd") as file:
                return file.read()

        for batch in batches:
            for archive, segments in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name = f"{zlib.crc32(str(archive).encode()):08x}-{''.join(c if c.isalnum() else '_' for c in str(archive))[:80]}-{attempt}.zip"
                count = at = 0
                last: Entry | None = None  # of all segments before
                totals: dict[int, int] = {}  # packed size of the last entry that begins in a segment, if it goes on in others
                owner = -1
                with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                    for j, s in enumerate(segments):
                        if s["ahead"]:
                            totals[owner] = totals.get(owner, last.packed) + s["ahead"]
                            if totals[owner] > MAX32:
                                raise ArchiveError("unsupported", f"zip64 not implemented for file: {last.text}")
                        with fs.open_input_file(open_shared(s["segment"])[1]) as piece:
                            if s["patch"] >= 0:
                                left = s["patch"]
                                while left and (data := piece.read(min(PIECE, left))):
                                    out.write(data)
                                    left -= len(data)
                                tail = descriptor(Entry(last.name, last.flag, last.method, last.crc, totals.get(owner, last.packed), last.size, 0, last.directory))
                                piece.seek(s["patch"] + len(tail))
                                out.write(tail)
                            while data := piece.read(PIECE):
                                out.write(data)
                        for e in _entries_of(side(s)):
                            last, owner = e, j
                    size = 0
                    for j, s in enumerate(segments):
                        held = None
                        for e in _entries_of(side(s)):
                            e.offset += at
                            if held is not None:
                                size += out.write(directory_record(held))
                            held, count = e, count + 1
                        if held is not None:
                            held.packed = totals.get(j, held.packed)
                            size += out.write(directory_record(held))
                        at += s["bytes"]
                    end = end_records(count, size, at)
                    out.write(end)
                yield pa.record_batch([pa.array([x]) for x in (archive, f"{folder}/{name}", count, at + size + len(end))], ["archive", "path", "n_entries", "bytes"])

    return run


def create_archives(entries: DataFrame, *, profile: str = "fast", chunk: int = X.MIB, password: str | None = None, folder: str | None = None, parts: int | None = None, adaptive: bool = True, seed: int | None = None) -> DataFrame:
    """Write an archive for each value of ``archive``; returns archive, path, n_entries, bytes.

    ``entries`` has archive, archive_path, is_directory, content, and entry_index (else by path). Names may repeat.
    Entries of more than one chunk are dealt to tasks by chunks; the bytes do not depend on how.
    No entries make no archive. The cipher's headers are random; with a ``seed`` encrypted archives can be made again.
    """
    spark = entries.sparkSession
    planned = plan_entries(numbered(entries), profile=profile, chunk=chunk, encrypt=password is not None, adaptive=adaptive)
    folder = folder or new_path(spark, "archives")
    fs, root = open_shared(folder)
    fs.create_dir(root, recursive=True)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = _dealt(planned).repartitionByRange(parts, "archive", "entry_index", "chunk_index").sortWithinPartitions("archive", "entry_index", "chunk_index")
    segments = stored(dealt.mapInArrow(_segments(folder, password, seed), SEGMENT), "segments")
    whole = segments.groupBy("archive").agg(F.array_sort(F.collect_list(F.struct("first", "chunk", "segment", "bytes", "ahead", "patch"))).alias("segments"))
    return stored(whole.mapInArrow(_assemble(folder), "archive string, path string, n_entries long, bytes long"), "archives")


DIRECTORY = "archive string, path string, bytes long, entry_index long, name string, name_raw binary, flag int, encrypted boolean, method int, method_name string, crc32 long, packed long, size long, offset long, is_directory boolean, status string, message string"


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows: list[tuple] = []
            size = None
            try:
                fs, at = open_shared(path)
                with fs.open_input_file(at) as file:
                    size = file.size()
                    for k, e in enumerate(parse_directory(Ranges(file, size))):
                        name = {STORE: "store", DEFLATE: "deflate"}.get(e.method, "unknown")
                        rows.append((archive, path, size, k, e.text, e.name, e.flag, e.encrypted, e.method, name, e.crc, e.packed, e.size, e.offset, e.directory, "ok", None))
                        if len(rows) >= 10_000:
                            yield _batch(rows, _DIRECTORY)
                            rows = []
            except FileNotFoundError:
                rows.append((archive, path, size, *[None] * 12, "not_found", f"archive not found: {path}"))
            except ArchiveError as e:
                rows.append((archive, path, size, *[None] * 12, e.status, e.message))
            if rows:
                yield _batch(rows, _DIRECTORY)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])


_DIRECTORY = _schema(DIRECTORY)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def list_archives(archives: DataFrame) -> DataFrame:
    """A row for each entry of archives (archive, path), in the order of their directories by entry_index.

    An archive that can't be listed gives what was read before the damage, and a row with its status and message.
    """
    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select(F.col("archive").cast("string"), "path").repartition(parts).mapInArrow(_list, DIRECTORY)


CHECKS = "archive string, path string, entry_index long, name string, crc32 long, size long, status string, message string, content binary"
_CHECKS = _schema(CHECKS)


def decode(r: Ranges, e: Entry, password: str | None, clear: bytes | None = None, tried: bool = False) -> bytes:
    """Content of an entry, all checks made; if ``tried``, ``clear`` is its data decrypted with others', or None for a wrong password."""
    if e.method == AES:
        raise ArchiveError("unsupported", f"winzip aes encrypted entries are not implemented: {e.text}")
    if e.method not in (STORE, DEFLATE):
        raise ArchiveError("unsupported", f"zip extraction method is not implemented yet: {e.text}")
    at, verifier = locate(r, e)
    data = r.read(at, e.packed, "file data exceeds archive size")
    if e.encrypted:
        if not password:
            raise ArchiveError("invalid_job", "zip password is required when encryption is enabled")
        if len(data) < 12:
            raise ArchiveError("invalid_job", f"encrypted zip entry is truncated: {e.text}")
        if not tried:
            clear = codecs.decrypt_all([data], [verifier], password.encode())[0]
        if clear is None:
            raise ArchiveError("invalid_job", f"zip password is incorrect: {e.text}")
        data = clear
    if e.method == DEFLATE:
        unpack = zlib.decompressobj(-15)
        try:
            data = unpack.decompress(data, e.size + 1)
        except zlib.error:
            raise ArchiveError("invalid_job", f"deflate decompression failed while reading: {e.text}") from None
        if len(data) != e.size or not unpack.eof or unpack.unused_data:
            raise ArchiveError("invalid_job", f"uncompressed size mismatch while reading: {e.text}")
    elif len(data) != e.size:
        raise ArchiveError("invalid_job", f"store entry size mismatch: {e.text}")
    return data


def _decrypted(batch: pa.RecordBatch, password: str) -> dict[int, bytes | None]:
    """Clear data of the encrypted entries of a batch by row, many at a time; None for a wrong password, as :func:`decode` need not try it again.

    Entries that can't be read are left to :func:`decode`.
    """
    out: dict[int, bytes | None] = {}
    group: list[tuple[int, bytes, int]] = []

    def flush() -> None:
        for (k, _, _), clear in zip(group, codecs.decrypt_all([x[1] for x in group], [x[2] for x in group], password.encode())):
            out[k] = clear
        group.clear()

    held = 0
    for k, (path, size, flag, method, crc, packed, offset) in enumerate(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("path", "bytes", "flag", "method", "crc32", "packed", "offset")))):
        if not flag & ENCRYPTED or packed > PIECE:
            continue
        fs, at = open_shared(path)
        with fs.open_input_file(at) as file:
            r, e = Ranges(file, size), Entry(b"", flag, method, crc, packed, 0, offset, False)
            try:
                data, verifier = locate(r, e)
                group.append((k, r.read(data, packed, ""), verifier))
            except ArchiveError:
                continue
        held += packed
        if held > PIECE:
            flush()
            held = 0
    flush()
    return out


def _read(password: str | None, content: bool):
    doing = "extracting" if content else "validating"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held, opened, file = [], 0, None, None
            together = _decrypted(batch, password) if password else {}
            for at_row, (archive, path, size, index, name, raw_name, flag, method, crc, packed, full, offset, unsafe) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                e = Entry(raw_name, flag, method, crc, packed, full, offset, False)
                data, got = None, None
                try:
                    if unsafe:
                        raise ArchiveError("invalid_job", f"unsafe archive path: {name}")
                    if path != opened:
                        if file is not None:
                            file.close()
                        fs, at = open_shared(path)
                        file, opened = fs.open_input_file(at), path
                    data = decode(Ranges(file, size), e, password, together.get(at_row), at_row in together)
                    got = zlib.crc32(data)
                    if got != crc:
                        raise ArchiveError("invalid_job", f"crc mismatch while {doing}: {name}")
                    status = ("ok", None)
                except ArchiveError as x:
                    status, data = (x.status, x.message), None
                rows.append((archive, path, index, name, got, full, *status, data if content else None))
                held += len(data or b"")
                if held > PIECE or len(rows) >= 2000:
                    yield _batch(rows, _CHECKS)
                    rows, held = [], 0
            if file is not None:
                file.close()
            if rows:
                yield _batch(rows, _CHECKS)

    return run


def _entries(archives: DataFrame, password: str | None, content: bool) -> DataFrame:
    listed = stored(list_archives(archives), "directory")
    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = listed.where("status = 'ok' and not is_directory").withColumn("unsafe", X.unsafe_path(F.col("name")))
    files = files.select("archive", "path", "bytes", "entry_index", "name", "name_raw", "flag", "method", "crc32", "packed", "size", "offset", "unsafe")
    read = files.repartitionByRange(parts, "path", "offset").sortWithinPartitions("path", "offset").mapInArrow(_read(password, content), CHECKS)
    none = F.lit(None)
    failed = listed.where("status <> 'ok'").select("archive", "path", none.cast("long").alias("entry_index"), none.cast("string").alias("name"), none.cast("long").alias("crc32"), none.cast("long").alias("size"), "status", "message", none.cast("binary").alias("content"))
    return read.unionByName(failed)


def extract_archives(archives: DataFrame, *, password: str | None = None) -> DataFrame:
    """A row for each file of the archives with its content, or with what failed; directories are left out."""
    return _entries(archives, password, True)


def test_archives(archives: DataFrame, *, password: str | None = None) -> DataFrame:
    """A row for each file of the archives with its status and message, without content."""
    return _entries(archives, password, False).drop("content")


def first_failure(checks: DataFrame) -> DataFrame:
    """``archive, status, message, files``: that of the failed entry with the lowest index, or ok."""
    bad = F.col("status") != "ok"
    order = F.coalesce(F.col("entry_index"), F.lit(-1))
    return checks.groupBy("archive").agg(F.coalesce(F.min_by(F.when(bad, F.col("status")), F.when(bad, order)), F.lit("ok")).alias("status"), F.min_by(F.when(bad, F.col("message")), F.when(bad, order)).alias("message"), F.count("entry_index").alias("files"))


def with_offsets(entries: DataFrame) -> DataFrame:
    """Adds the local header's offset: a running sum of record sizes in each archive, over (archive, archive_path, packed, flag, entry_index).

    It runs in blocks of 4096 indexes and over the sums of blocks, so no archive is put in order by one task.
    """
    rows = entries.withColumn("_record", X.local_record_size(F.col("archive_path"), F.col("packed"), F.col("flag"))).withColumn("_block", F.floor(F.col("entry_index") / 4096))
    blocks = rows.groupBy(F.col("archive").alias("_a"), F.col("_block").alias("_b")).agg(F.sum("_record").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.partitionBy("_a").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("_a", "_b", before.alias("_before"))
    inside = F.coalesce(F.sum("_record").over(W.partitionBy("archive", "_block").orderBy("entry_index").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    both = rows.withColumn("_inside", inside).join(blocks, (F.col("archive") == F.col("_a")) & (F.col("_block") == F.col("_b")))
    return both.withColumn("offset", F.col("_before") + F.col("_inside")).drop("_record", "_block", "_a", "_b", "_before", "_inside")


def chunk_rows(entries: DataFrame, chunk: int, *, key: str = "entry_index", content_col: str = "content") -> DataFrame:
    """Entries as chunk rows: key, chunk_index, is_last, raw_size, payload. An empty entry is one empty chunk."""
    n = F.octet_length(content_col).cast("long")
    count = X.chunk_count(n, F.lit(chunk).cast("long"))
    rows = entries.select(key, F.coalesce(content_col, F.lit(b"").cast("binary")).alias("_c"), F.coalesce(count, F.lit(1).cast("long")).alias("_n"))
    rows = rows.select(key, "_c", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("chunk_index"))
    payload = F.substring("_c", (F.col("chunk_index") * chunk + 1).cast("int"), F.lit(chunk))
    return rows.select(key, "chunk_index", (F.col("chunk_index") == F.col("_n") - 1).alias("is_last"), F.octet_length(payload).cast("long").alias("raw_size"), payload.alias("payload"))


def reassembled(chunks: DataFrame, *, key: str = "entry_index", payload_col: str = "payload") -> DataFrame:
    """``key, payload`` with the chunks of each entry in order; an entry's packed size bounds the group."""
    parts = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk_index", F.col(payload_col).alias("p")))).alias("_parts"))
    return parts.select(key, F.unhex(F.array_join(F.transform("_parts", lambda x: F.hex(x["p"])), "")).alias("payload"))
