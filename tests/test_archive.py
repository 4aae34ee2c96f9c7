import io
import os
import subprocess
import sys
import zipfile
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from parcelyard.functions import codecs
from parcelyard.functions import expressions as X
from parcelyard.operators import archive as A
from parcelyard.plans.jobs import Context, Operation, Options, Phase, Profile, Request, Source, Status, execute
from parcelyard.sources import datasource
from parcelyard.sources.records import Entry, Ranges, directory_record, end_records, parse_directory

FILES = [("a/one.txt", b"hello " * 5000), ("a/empty", b""), ("b/é.bin", bytes(range(256)) * 700), ("same", b"1"), ("same", b"2")]


def entries(spark, files=FILES, archive="x"):
    rows = [(archive, k, name, name.endswith("/"), body) for k, (name, body) in enumerate(files)]
    return spark.createDataFrame(rows, "archive string, entry_index long, archive_path string, is_directory boolean, content binary")


def body_of(made):
    return open(made.first().path, "rb").read()


@pytest.mark.parametrize("profile", ["store", "fast", "balanced", "small", "maximum"])
@pytest.mark.parametrize("chunk", [65536, 1 << 20])
def test_other_tools_read_what_is_written(spark, profile, chunk):
    made = A.create_archives(entries(spark), profile=profile, chunk=chunk)
    with zipfile.ZipFile(io.BytesIO(body_of(made))) as z:
        assert z.testzip() is None
        assert [(i.filename, z.read(i)) for i in z.infolist()] == FILES


def test_bytes_do_not_depend_on_partitions(spark):
    assert len({body_of(A.create_archives(entries(spark), parts=n)) for n in (1, 3, 16)}) == 1


def test_reads_what_other_tools_write(spark, tmp_path):
    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("d/", b"")
        for k, (name, body) in enumerate(FILES[:4]):
            z.writestr(name, body, zipfile.ZIP_DEFLATED if k % 2 else zipfile.ZIP_STORED)
    table = spark.createDataFrame([("x", str(path))], "archive string, path string")
    got = {r.name: bytes(r.content) for r in A.extract_archives(table).collect()}
    assert got == dict(FILES[:4])
    assert A.list_archives(table).where("is_directory").count() == 1


def test_encryption(spark):
    made = A.create_archives(entries(spark, FILES[:3]), password="pw")
    body = body_of(made)
    assert b"hello hello" not in body
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        assert [z.read(i, pwd=b"pw") for i in z.infolist()] == [b for _, b in FILES[:3]]
    ok = A.test_archives(made, password="pw").collect()
    assert {r.status for r in ok} == {"ok"}
    assert all(r.status == "invalid_job" for r in A.test_archives(made, password="no").collect())
    assert A.test_archives(made).first().message == "zip password is required when encryption is enabled"


def damaged(change):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("f", b"some content")
    body = bytearray(out.getvalue())
    return bytes(change(body))


def flip(body, at, value):
    body[at] = value
    return body


@pytest.mark.parametrize(
    "change, message",
    [
        (lambda b: b[:10], "archive is too small"),
        (lambda b: b.replace(b"PK\5\6", b"XXXX"), "end of central directory record not found"),
        (lambda b: flip(b, b.find(b"PK\1\2"), 0), "invalid central directory signature"),
        (lambda b: flip(b, 0, 0), "invalid local file header signature"),
        (lambda b: flip(b, 32, b[32] ^ 1), "crc mismatch while validating"),
        (lambda b: flip(b, 8, 8), "local header compression method mismatch"),
        (lambda b: b.replace(b"f", b"\\"), "unsafe archive path"),
        (lambda b: flip(flip(b, 8, 12), b.find(b"PK\1\2") + 10, 12), "zip extraction method is not implemented yet"),
        (lambda b: flip(b, b.find(b"PK\5\6") + 19, 9), "central directory points outside the archive"),
    ],
)
def test_damage_is_told(spark, tmp_path, change, message):
    path = tmp_path / "x.zip"
    path.write_bytes(damaged(change))
    row = A.first_failure(A.test_archives(spark.createDataFrame([("x", str(path))], "archive string, path string"))).first()
    assert row.status != "ok" and row.message.startswith(message)


def test_zip64_offsets_and_counts():
    e = Entry(b"far", 8, 0, 1, 2, 2, 5 << 32, False)
    body = directory_record(e)
    tail = end_records(1, len(body), 0)
    assert list(parse_directory(Ranges(io.BytesIO(body + tail), len(body + tail)))) == [e]
    assert len(end_records(70_000, 1, 1)) == 98


def test_chunks_join(spark):
    rows = A.chunk_rows(entries(spark), 1000)
    packed = rows.withColumn("z", codecs.zip_deflate_chunk("payload", F.lit(1), F.col("is_last")))
    for r in A.reassembled(packed, payload_col="z").collect():
        assert zlib.decompress(r.payload, -15) == FILES[r.entry_index][1]


def test_expressions(spark):
    row = spark.range(1).select(
        X.in_flight(F.lit(2048), F.lit(1 << 20)).alias("a"), X.in_flight(F.lit(0), F.lit(1 << 20)).alias("b"), X.in_flight(F.lit(1), F.lit(1 << 20)).alias("c"),
        X.mapped_limit(F.lit(4096)).alias("d"), X.human_bytes(F.lit(1536)).alias("e"), X.extract_path(F.lit(8), F.lit(False), F.lit(64 << 20), F.lit(9), F.lit(2048)).alias("f"), X.extraction_root(F.lit("/a.b/c.zip")).alias("g"),
    ).first()
    assert tuple(row) == (128, 32, 1, 3072 << 20, "1.5 KB", "mapped", "/a.b/c")


def test_data_source(spark, tmp_path):
    datasource.register(spark)
    path = str(tmp_path / "out.zip")
    rows = spark.createDataFrame([("x/1", b"one" * 100), ("x/2", b"")], "name string, content binary").coalesce(1)
    rows.write.format("ziparchive").mode("append").save(path)
    got = spark.read.format("ziparchive").load(path)
    assert [(r.name, bytes(r.content), r.status) for r in got.orderBy("entry_index").collect()] == [("x/1", b"one" * 100, "ok"), ("x/2", b"", "ok")]
    assert spark.read.format("ziparchive").option("content", "false").load(path).where("content is not null").count() == 0
    assert zipfile.ZipFile(path).testzip() is None


def test_jobs(spark, tmp_path):
    root = tmp_path / "in"
    (root / "sub" / "void").mkdir(parents=True)
    (root / "sub" / "a b.txt").write_bytes(b"x" * 1000)
    (root / "top").write_bytes(b"")
    out, seen = str(tmp_path / "o.zip"), []
    context = Context(on_progress=seen.append)
    made = execute(spark, Request(Operation.CREATE, (Source(str(root)),), out, Profile.SMALL), context)
    assert made.status is Status.OK, made.message
    assert made.message.startswith("created zip archive entries=5")
    assert seen[0].phase is Phase.STARTED and seen[-1].phase is Phase.COMPLETED
    assert sorted(zipfile.ZipFile(out).namelist()) == ["in/", "in/sub/", "in/sub/a b.txt", "in/sub/void/", "in/top"]
    listed = execute(spark, Request(Operation.LIST, (Source(out),)))
    assert listed.message == "zip entries=5" and "method=deflate(8) encrypted=no" in listed.rows.where("not is_directory").first().line
    assert execute(spark, Request(Operation.TEST, (Source(out),))).message == "tested zip archive files=2 status=ok"
    done = execute(spark, Request(Operation.EXTRACT, (Source(out),), str(tmp_path / "back")))
    assert done.status is Status.OK, done.message
    assert (tmp_path / "back/in/sub/a b.txt").read_bytes() == b"x" * 1000 and (tmp_path / "back/in/sub/void").is_dir()


def test_bad_jobs(spark, tmp_path):
    told = []
    bad = lambda r: execute(spark, r, Context(on_diagnostic=lambda *x: told.append(x))).status
    assert bad(Request(Operation.LIST)) is Status.INVALID_JOB
    assert bad(Request(Operation.CREATE, (Source("/nowhere"),), str(tmp_path / "x.zip"))) is Status.NOT_FOUND
    assert bad(Request(Operation.LIST, (Source("/nowhere.zip"),))) is Status.NOT_FOUND
    assert len(told) == 3
    assert execute(spark, Request(Operation.LIST, (Source("/x"),)), Context(cancelled=lambda: True)).status is Status.CANCELLED
    assert Options(password="x").resolved().value == "zip-traditional"


def test_command_line():
    said = subprocess.run([sys.executable, "-m", "parcelyard", "version"], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(__file__)))
    assert said.stdout.strip() == "0.1.0"


def test_arriving_archives(spark, tmp_path):
    from parcelyard.streaming.arrivals import arriving_entries

    (tmp_path / "x.zip").write_bytes(body_of(A.create_archives(entries(spark))))
    stream = arriving_entries(spark, str(tmp_path)).writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    stream.awaitTermination(120)
    assert spark.table("arrived").count() == len(FILES)


def test_numbering_needs_names_only(spark):
    rows = [(a, f"n{k % 37:02}", k % 5 == 0, bytes([k])) for a in ("x", "y") for k in range(150)] + [("x", None, False, b"")]
    table = spark.createDataFrame(rows, "archive string, archive_path string, is_directory boolean, content binary").repartition(6)
    got = A.placed(table, "archive", ["archive_path", "is_directory"]).collect()
    assert len(got) == len(rows)
    for a in ("x", "y"):
        mine = sorted((r for r in got if r.archive == a), key=lambda r: r.entry_index)
        assert [r.entry_index for r in mine] == list(range(len(mine)))
        key = [(r.archive_path is not None, r.archive_path or "", r.is_directory) for r in mine]
        assert key == sorted(key)


def test_cipher_headers_are_random_unless_seeded(spark):
    made = lambda **o: body_of(A.create_archives(entries(spark, FILES[:3]), password="pw", **o))
    assert made() != made() and made(seed=1) == made(seed=1) != made(seed=2)


def test_data_source_reads_slices(spark, tmp_path):
    datasource.register(spark)
    with zipfile.ZipFile(tmp_path / "many.zip", "w") as z:
        for k in range(257):
            z.writestr(f"e{k}", str(k) * k)
    got = spark.read.format("ziparchive").option("entriesPerPartition", "50").load(str(tmp_path))
    assert got.rdd.getNumPartitions() == 6
    assert [(r.entry_index, r.name, bytes(r.content)) for r in got.orderBy("entry_index").collect()] == [(k, f"e{k}", (str(k) * k).encode()) for k in range(257)]


def test_chunks_of_large_entries_go_to_many_tasks(spark):
    """Bytes are those of one task, also where a task begins or ends inside an entry, and other tools read them."""
    import numpy as np

    noise = np.random.default_rng(5).integers(0, 40, 3 << 20, np.uint8).tobytes()
    files = [("small", b"s"), ("large", noise), ("empty", b""), ("next", noise[: 1 << 20][::-1]), ("d/", b""), ("photo.jpg", noise + noise[: 2 << 20]), ("end", b"e" * 200_000)]
    rows = entries(spark, files)
    for adaptive in (False, True):
        one = A.create_archives(rows, chunk=65536, parts=1, adaptive=adaptive)
        many = A.create_archives(rows, chunk=65536, parts=24, adaptive=adaptive)
        assert body_of(one) == body_of(many)
        with zipfile.ZipFile(io.BytesIO(body_of(many))) as z:
            assert z.testzip() is None
            assert [(i.filename, z.read(i)) for i in z.infolist()] == files
    dealt = A._dealt(A.plan_entries(rows, chunk=65536)).repartitionByRange(24, "archive", "entry_index", "chunk_index")
    tasks = dealt.where("archive_path = 'large'").select(F.spark_partition_id().alias("p"), "payload").groupBy("p").agg(F.max(F.octet_length("payload")).alias("n")).collect()
    assert len(tasks) >= 6 and max(r.n for r in tasks) <= 65536
    checks = {r.name: r.status for r in A.test_archives(many).collect()}
    assert set(checks.values()) == {"ok"} and len(checks) == 6
    sealed = A.create_archives(rows, chunk=65536, parts=24, password="pw", seed=1)
    assert {r.name: bytes(r.content) for r in A.extract_archives(sealed, password="pw").collect()} == {k: v for k, v in files if not k.endswith("/")}


def test_wrong_password_reads_headers_only(spark, monkeypatch):
    """Every entry is refused by its header, once; only the one in 256 that the verifier lets pass is decrypted."""
    files = [(f"f{k:02}", bytes([k % 251]) * 7 + b"some words %d " % k * 40 * (k % 9)) for k in range(80)]
    made = A.create_archives(entries(spark, files), password="pw", seed=3)
    with zipfile.ZipFile(io.BytesIO(body_of(made))) as z:
        assert [(i.filename, z.read(i, pwd=b"pw")) for i in z.infolist()] == files
        sizes = {i.filename: i.compress_size for i in z.infolist()}
    listed = A.list_archives(made).withColumn("unsafe", F.lit(False)).orderBy("offset")
    columns = ["archive", "path", "bytes", "entry_index", "name", "name_raw", "flag", "method", "crc32", "packed", "size", "offset", "unsafe"]
    batches = listed.select(columns).toArrow().combine_chunks().to_batches()
    seen, cipher = [], codecs._cipher
    monkeypatch.setattr(codecs, "_cipher", lambda payloads, *rest: seen.extend(map(len, payloads)) or cipher(payloads, *rest))
    rows = [r for b in A._read("another", False)(iter(batches)) for r in b.to_pylist()]
    assert {r["name"] for r in rows} == set(sizes) and all(r["status"] == "invalid_job" for r in rows)
    passed = [r["name"] for r in rows if r["message"] != f"zip password is incorrect: {r['name']}"]
    assert len(passed) < 5 and sorted(seen) == sorted([12] * len(files) + [sizes[n] for n in passed])
    seen.clear()
    assert all(r["status"] == "ok" for b in A._read("pw", False)(iter(batches)) for r in b.to_pylist())
    assert sum(seen) == 12 * len(files) + sum(sizes.values())


def test_human_bytes_rounds_halves_to_even(spark):
    """As printf of the exact quotient, also right beside a half, for negative numbers, null and the largest."""
    units = {1 << 10 * p: u for p, u in enumerate(("B", "KB", "MB", "GB", "TB"))}
    sizes = {0, 1, 999, 1023, -1, -1536, (1 << 63) - 1, (1 << 53) + 1}
    for unit in list(units)[1:]:
        for part in (4, 5, 7, 9, 396, 397, 398, 399, 400, 402, 404, 406, 410, 4094, 4095):  # quarters
            sizes |= {unit * part // 4 + k for k in (-1, 0, 1)}
        sizes |= {unit * k // 20 + j for k in range(20, 60) for j in (-1, 0, 1)}

    def plain(n):
        unit = max((u for u in units if n >= u), default=1)
        if unit == 1:
            return f"{n} B"
        tenths = n < 100 * unit
        q = round(Fraction(n * (10 if tenths else 1), unit))  # halves to even
        return f"{q // 10}.{q % 10} {units[unit]}" if tenths else f"{q} {units[unit]}"

    table = spark.createDataFrame([(n,) for n in sorted(sizes)] + [(None,)], "n long")
    got = {r.n: r.t for r in table.select("n", X.human_bytes(F.col("n")).alias("t")).collect()}
    assert got.pop(None) is None
    assert got == {n: plain(n) for n in sizes}
    assert [got[n] for n in (1280, 1792, 102912, 103936, (1 << 30) * 5 // 4)] == ["1.2 KB", "1.8 KB", "100 KB", "102 KB", "1.2 GB"]


def test_format_bytes_of_halves_has_the_rows_of_its_sql(spark, tmp_path):
    import duckdb

    from parcelyard.plans import queries

    ties = [(342149885, 5), (767404694, 6), (751134717, 5), (224073828, 4), (119703243, 3), (170200470, 6), (746075645, 5), (836670820, 4), (189553455, 7), (636942876, 3), (2922493, 5), (7334091, 3), (8828669, 5), (None, 1), (-7, 2)]
    spark.createDataFrame(ties, "l_orderkey long, l_linenumber int").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.l_orderkey, r.l_linenumber): r.text for r in queries.QUERIES["format_bytes"](spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == {(a, b): c for a, b, c in db.execute(queries.SQL["format_bytes"]).fetchall()} and len(got) == len(ties)
