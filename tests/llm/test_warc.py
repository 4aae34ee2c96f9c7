"""WARC ids and headers of any kind, against the query's SQL, and how much of a file is read."""

import gzip
import io
import struct
import zlib

import duckdb
import pytest

from parcelyard.llm import queries, warc


def equal_to_sql(spark, folder, rows, kind):
    table = spark.createDataFrame([(*r, "x") for r in rows], f"page_id {kind}, url string, html string, digest string").repartition(3)
    table.write.parquet(f"{folder}/pages.parquet")
    got = queries.op2_warc(spark, str(folder)).collect()
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
        cursor = db.execute(queries.SQL["op2_warc"])
        names = [c[0] for c in cursor.description]
        want = cursor.fetchall()
    assert len(got) == len(rows)
    assert sorted((tuple(r[n] for n in names) for r in got), key=str) == sorted(want, key=str)


def test_ids_that_are_null_or_repeat(spark, tmp_path):
    page = "a page of some length " * 9
    rows = [(None, "http://a/", page), (3, "http://b/", page), (3, "http://c/", page), (9, None, page), (None, None, None), (4, "http://d/" + "u" * 70_000, page + "!"), (9, "x", "")]
    equal_to_sql(spark, tmp_path, rows, "long")


def test_ids_that_are_strings(spark, tmp_path):
    page = "a page of some length " * 9
    ids = ["a:b", "", "%41", "é <b> /?", "line\nend", "None", None, "a b", "urn:page-without-id"]
    equal_to_sql(spark, tmp_path, [(i, "http://a/", page) for i in ids] + [(f"z{i}", "u", "short") for i in ids], "string")


def member_with_long_header(body):
    extra, name = b"xx" + struct.pack("<H", 60_000) + bytes(60_000), b"n" * 9000 + b"\0"
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    return b"\x1f\x8b\x08\x0c" + bytes(6) + struct.pack("<H", len(extra)) + extra + name + pack.compress(body) + pack.flush() + struct.pack("<II", zlib.crc32(body), len(body))


def test_gzip_headers_of_any_length():
    plain = [warc.record("response", f"urn:page:{k}", {}, bytes([65 + k]) * 300, None) for k in range(4)]
    members = [gzip.compress(plain[0]), member_with_long_header(plain[1]), gzip.compress(plain[2]), member_with_long_header(plain[3])]
    assert gzip.decompress(members[1]) == plain[1]
    body = b"".join(members)
    assert [x.headers["warc-record-id"][-2] for x in warc.salvage(io.BytesIO(body), len(body))] == list("0123")
    damaged = members[0] + members[1] + b"junk" + members[2][:-9] + members[3]
    out = list(warc.salvage(io.BytesIO(damaged), len(damaged)))
    assert [x.headers["warc-record-id"][-2] if isinstance(x, warc.Record) else "gap" for x in out] == ["0", "1", "gap", "gap", "3"]
    assert sum(x.end - x.start for x in out) == len(damaged)


class Counting(io.BytesIO):
    n = 0

    def read(self, size=-1):
        out = super().read(size)
        self.n += len(out)
        return out


@pytest.mark.parametrize("level", [1, None])
@pytest.mark.parametrize("sizes", [[2500] * 1500, [3 << 20, 100, 5 << 20, 2 << 20], [40] * 4000])
def test_bytes_are_read_about_once(level, sizes):
    from random import Random

    r = Random(5)
    some = [warc.record("response", f"urn:page:{k}", {}, r.randbytes(n // 2) * 2, level) for k, n in enumerate(sizes)]
    file = Counting(b"".join(some))
    size = len(file.getvalue())
    assert len(list(warc.salvage(file, size))) == len(sizes)
    assert file.n <= 1.2 * size
    # In ranges, each may read one piece beyond its end
    file, found = Counting(file.getvalue()), 0
    step = max(size // 3, 1)
    for low in range(0, size, step):
        found += len(list(warc.salvage(file, size, low, low + step)))
    assert found == len(sizes) and file.n <= 1.2 * size + 8 * (warc.PIECE + max(sizes))


def test_bounds_of_files(spark):
    pages = spark.createDataFrame([(k, "u", "page text " * 50 + str(k)) for k in range(60)], "page_id long, url string, html string").coalesce(1)
    files = warc.write_warc(pages, file_bytes=4000)
    assert files.count() > 3 and sum(r.n_records for r in files.collect()) == 60
    assert warc.read_warc(files, strict=True).count() == 60
