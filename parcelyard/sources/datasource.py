"""The data source ``ziparchive``: archives as rows to read, and rows as an archive to write.

Reading gives a row per entry; a partition is a slice of the entries of one file and reads byte ranges only. With
``content`` false nothing but directories is read. Writing takes (name, content), or any row with these columns; each
task writes a segment, and the commit joins them in the order of partitions and writes the directory.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions import codecs
from ..functions.expressions import MIB
from ..storage import open_shared
from .records import DEFLATE, HAS_DESCRIPTOR, STORE, UTF8, Entry, Ranges, descriptor, directory_range, directory_record, end_records, local_header, placed_entries

SCHEMA = "path string, entry_index long, name string, flag int, method int, crc32 long, packed long, size long, offset long, is_directory boolean, status string, message string, content binary"


@dataclass
class Slice(InputPartition):
    path: str
    low: int
    high: int
    at: int  #: of the first record within the directory


def _files(path: str) -> list[str]:
    from pyarrow import fs as arrow

    fs, at = open_shared(path)
    info = fs.get_file_info(at)
    if info.type == arrow.FileType.Directory:
        found = fs.get_file_info(arrow.FileSelector(at, recursive=True))
        return sorted(x.path for x in found if x.type == arrow.FileType.File and x.path.endswith(".zip"))
    return [at]


class ZipReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.content = options.get("content", "true").lower() == "true"
        self.password = options.get("password")
        self.step = int(options.get("entriesperpartition", "5000"))

    def partitions(self) -> list[Slice]:
        """Only the end of a file is read here, and of one with several slices the directory, to find where they begin."""
        out = []
        for path in _files(self.path):
            fs, at = open_shared(path)
            with fs.open_input_file(at) as file:
                r = Ranges(file, file.size())
                n = directory_range(r)[0]
                starts = [0] if n <= self.step else [place for k, (place, _) in enumerate(placed_entries(r)) if k % self.step == 0]
            out += [Slice(path, k * self.step, min(n, (k + 1) * self.step), place) for k, place in enumerate(starts) if n]
        return out or [Slice("", 0, 0, 0)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        from ..operators.archive import ArchiveError, decode

        if not partition.path:
            return
        fs, at = open_shared(partition.path)
        with fs.open_input_file(at) as file:
            r = Ranges(file, file.size())
            for k, (_, e) in enumerate(placed_entries(r, partition.at, partition.high - partition.low), partition.low):
                content, status = None, ("ok", None)
                if self.content and not e.directory:
                    try:
                        content = decode(r, e, self.password)
                        if zlib.crc32(content) != e.crc:
                            raise ArchiveError("invalid_job", f"crc mismatch while extracting: {e.text}")
                    except ArchiveError as x:
                        content, status = None, (x.status, x.message)
                yield partition.path, k, e.text, e.flag, e.method, e.crc, e.packed, e.size, e.offset, e.directory, *status, content


@dataclass
class Segment(WriterCommitMessage):
    part: int
    path: str
    entries: list[tuple]


class ZipWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.level = codecs.LEVELS[options.get("profile", "fast")]
        self.method = STORE if options.get("profile") == "store" else DEFLATE
        self.chunk = int(options.get("chunksizebytes", str(MIB)))

    def write(self, iterator: Iterator) -> Segment:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, at = open_shared(self.path)
        fs.create_dir(os.path.dirname(at), recursive=True)
        path, entries, size = f"{at}.part-{context.partitionId():06d}-{context.taskAttemptId()}", [], 0
        with fs.open_output_stream(path, compression=None) as out:
            for row in iterator:
                body = bytes(row["content"] or b"")
                name = row["name"].encode()
                folder = name.endswith(b"/")
                method = STORE if folder else self.method
                data = codecs.deflate(body, self.level, self.chunk) if method == DEFLATE else body
                flag = (0 if folder else HAS_DESCRIPTOR) | (UTF8 if not name.isascii() else 0)
                e = Entry(name, flag, method, zlib.crc32(body), len(data), len(body), size, folder)
                record = local_header(e) + data + descriptor(e)
                out.write(record)
                entries.append((e.name, flag, method, e.crc, e.packed, e.size, size, folder))
                size += len(record)
        return Segment(context.partitionId(), path, entries)

    def commit(self, messages: list[Segment | None]) -> None:
        fs, at = open_shared(self.path)
        from pyarrow import fs as arrow

        if not self.overwrite and fs.get_file_info(at).type != arrow.FileType.NotFound:
            self.abort(messages)
            raise FileExistsError(self.path)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.part)
        base = size = count = 0
        records = []
        with fs.open_output_stream(f"{at}.new", compression=None) as out:
            for m in parts:
                with fs.open_input_file(m.path) as piece:
                    while data := piece.read(8 << 20):
                        out.write(data)
                    here = piece.tell()
                for name, flag, method, crc, packed, full, offset, folder in m.entries:
                    records.append(directory_record(Entry(name, flag, method, crc, packed, full, base + offset, folder)))
                base += here
            for x in records:
                out.write(x)
                size, count = size + len(x), count + 1
            out.write(end_records(count, size, base))
        fs.move(f"{at}.new", at)  # the old archive, if any, is replaced as a whole
        for m in parts:
            fs.delete_file(m.path)

    def abort(self, messages: list[Segment | None]) -> None:
        fs, _ = open_shared(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(m.path)


class ZipArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ziparchive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ZipReader:
        return ZipReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> ZipWriter:
        return ZipWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZipArchive)
