"""Queries over the test tables that apply the archive operators, and DuckDB SQL with the same results.

A document is an entry named ``source/lang/doc_id.txt`` with its text as payload; where sizes of all magnitudes are
needed, each line item has a virtual one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import codecs
from ..functions import expressions as X
from ..operators import archive as A
from ..ship import ship
from ..sources import datasource

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{d}/{name}.parquet")


PATH = "coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || doc_id || '.txt'"
SIZE = "coalesce(octet_length(encode(text)), 0)::BIGINT"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select("doc_id", F.coalesce("source", F.lit("none")).alias("source"), "lang", path.alias("archive_path"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"))


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select(F.col("source").alias("archive"), "archive_path", F.lit(False).alias("is_directory"), "content", F.col("doc_id").alias("entry_index"))


VIRTUAL = "((l_orderkey::BIGINT * 2654435761 + l_linenumber::BIGINT * 40503) % 5368709120)"
KEYS = "l_orderkey::BIGINT AS l_orderkey, l_linenumber::BIGINT AS l_linenumber"


def _virtual(spark: SparkSession, d: str) -> DataFrame:
    v = (F.col("l_orderkey").cast("long") * 2654435761 + F.col("l_linenumber").cast("long") * 40503) % 5368709120
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("l_orderkey"), F.col("l_linenumber").cast("long").alias("l_linenumber"), v.alias("v"))


@query(f"SELECT {PATH} AS archive_path, {SIZE} AS size, 8 AS method, 8 AS flag FROM documents")
def collect_entries(spark, d):
    rows = A.plan_entries(A.collect_entries(_docs(spark, d)), adaptive=False)
    return rows.select("archive_path", "size", "method", "flag")


@query(f"""SELECT DISTINCT coalesce(source, 'none') || '/' AS archive_path, true AS is_directory FROM documents
UNION ALL SELECT DISTINCT coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/', true FROM documents
UNION ALL SELECT {PATH}, false FROM documents""")
def directory_entries(spark, d):
    return A.collect_entries(_docs(spark, d), with_directories=True).select("archive_path", "is_directory")


@query("SELECT page_id, replace(replace(url, '/', '\\'), '\\', '/') AS path, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered FROM pages")
def normalize_path(spark, d):
    return _t(spark, d, "pages").select("page_id", X.normal_path(F.translate("url", "/", "\\")).alias("path"), X.ascii_lower(F.col("url")).alias("lowered"))


@query(f"SELECT doc_id, p AS profile, CASE WHEN p = 'store' THEN 0 ELSE 8 END AS method, CASE p WHEN 'store' THEN 0 WHEN 'small' THEN 8 WHEN 'maximum' THEN 9 ELSE 1 END AS level FROM documents, unnest(['store', 'fast', 'balanced', 'small', 'maximum']) AS t(p)")
def method_by_profile(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", F.explode(F.array(*[F.lit(p) for p in codecs.LEVELS])).alias("profile"))
    return rows.select("doc_id", "profile", X.method_of(F.col("profile")).alias("method"), X.level_of(F.col("profile")).alias("level"))


_NAME = "'f' || l_orderkey || CASE l_linenumber % 4 WHEN 0 THEN '.ZIP' WHEN 1 THEN '.txt' WHEN 2 THEN '.jpeg' ELSE '' END"


@query(f"SELECT {KEYS}, {VIRTUAL} >= 4194304 AND l_linenumber % 4 IN (0, 2) AS prefers_store FROM lineitem")
def prefer_store_ext(spark, d):
    k = F.col("l_linenumber") % 4
    name = F.concat(F.lit("f"), F.col("l_orderkey").cast("string"), F.when(k == 0, ".ZIP").when(k == 1, ".txt").when(k == 2, ".jpeg").otherwise(""))
    return _virtual(spark, d).select("l_orderkey", "l_linenumber", X.prefers_store(name, F.col("v")).alias("prefers_store"))


@query(f"SELECT {KEYS}, {VIRTUAL} >= 8388608 AS candidate, CASE WHEN {VIRTUAL} >= 67108864 THEN 830 ELSE 980 END AS threshold FROM lineitem")
def adaptive_candidate(spark, d):
    return _virtual(spark, d).select("l_orderkey", "l_linenumber", X.adaptive_candidate(F.lit(False), F.lit(8), F.col("v")).alias("candidate"), X.adaptive_threshold(F.lit("fast"), F.col("v")).alias("threshold"))


_CHUNK = f"greatest(65536, 1048576, CASE WHEN {VIRTUAL} >= 1073741824 THEN 33554432 WHEN {VIRTUAL} >= 268435456 THEN 16777216 WHEN {VIRTUAL} >= 67108864 THEN 8388608 WHEN {VIRTUAL} >= 16777216 THEN 4194304 ELSE 0 END)"


@query(f"SELECT {KEYS}, o AS option, greatest(65536, o, ({_CHUNK} // 1048576) * CASE WHEN {VIRTUAL} >= 16777216 THEN 1048576 ELSE 0 END)::BIGINT AS chunk_size FROM lineitem, unnest([1, 65536, 3000000, 67108864]) AS t(o)")
def chunk_size_ladder(spark, d):
    rows = _virtual(spark, d).withColumn("option", F.explode(F.array(*[F.lit(o) for o in (1, 65536, 3000000, 67108864)])))
    return rows.select("l_orderkey", "l_linenumber", "option", X.chunk_size(F.col("v"), F.col("option")).alias("chunk_size"))


@query(f"SELECT {KEYS}, ({_CHUNK})::BIGINT AS chunk_size, greatest(1, ({VIRTUAL} + {_CHUNK} - 1) // {_CHUNK})::BIGINT AS chunk_count, 'chunked-cpu' AS execution_path FROM lineitem")
def chunk_plan(spark, d):
    size = X.chunk_size(F.col("v"), X.MIB)
    return _virtual(spark, d).select("l_orderkey", "l_linenumber", size.alias("chunk_size"), X.chunk_count(F.col("v"), size).alias("chunk_count"), X.execution_path(F.lit(False), F.lit(False), F.lit(8)).alias("execution_path"))


@query("SELECT p_partkey::BIGINT AS p_partkey, CASE WHEN p_partkey % 5000 = 0 THEN 32 ELSE greatest(1, least(128, (p_partkey % 5000) * 1048576 // (2 * (65536 * (1 + p_partkey % 300))))) END::BIGINT AS in_flight FROM part")
def pipeline_plan(spark, d):
    p = F.col("p_partkey").cast("long")
    return _t(spark, d, "part").select(p.alias("p_partkey"), X.in_flight(p % 5000, 65536 * (1 + p % 300)).cast("long").alias("in_flight"))


_PER_ORDER = f"(SELECT l_orderkey::BIGINT AS l_orderkey, count(*) AS n, sum({VIRTUAL}) AS total, max({VIRTUAL}) AS largest FROM lineitem GROUP BY l_orderkey)"


@query(f"""SELECT l_orderkey, total::BIGINT AS total, largest::BIGINT AS largest,
greatest(1048576, CASE WHEN total >= 34359738368 OR largest >= 4294967296 THEN 16777216 WHEN total >= 8589934592 OR largest >= 1073741824 THEN 8388608 WHEN total >= 2147483648 THEN 4194304 ELSE 0 END)::BIGINT AS chunk,
least(100, CASE WHEN total >= 34359738368 OR largest >= 4294967296 THEN 24 WHEN total >= 8589934592 OR largest >= 1073741824 THEN 32 ELSE 128 END)::BIGINT AS in_flight FROM {_PER_ORDER}""")
def pipeline_tuning(spark, d):
    per = _virtual(spark, d).groupBy("l_orderkey").agg(F.sum("v").alias("total"), F.max("v").alias("largest"))
    t, m = F.col("total"), F.col("largest")
    return per.select("l_orderkey", "total", "largest", X.tuned_chunk(t, m, F.lit(X.MIB).cast("long")).alias("chunk"), X.tuned_in_flight(t, m, F.lit(100)).cast("long").alias("in_flight"))


@query(f"""WITH f AS (SELECT l_orderkey::BIGINT AS l_orderkey, {VIRTUAL} AS v, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE 8 END AS m FROM lineitem),
g AS (SELECT *, m = 8 AND v BETWEEN 33554432 AND 1792::BIGINT * 1048576 AS mapped, m = 8 AND v <= 4294967295 AND v >= 67108864 AS streaming FROM f),
s AS (SELECT l_orderkey, count(*) AS n, sum(v) AS total, count(*) FILTER (mapped) AS mapped, count(*) FILTER (streaming) AS streaming,
sum(CASE WHEN m = 0 THEN CASE WHEN v >= 268435456 THEN 8 WHEN v >= 134217728 THEN 6 WHEN v >= 67108864 THEN 4 ELSE 2 END WHEN mapped THEN 9 WHEN streaming THEN 8 WHEN v >= 8388608 THEN 4 ELSE 2 END) AS score FROM g GROUP BY l_orderkey),
w AS (SELECT *, least(n, 16, 14) AS most FROM s),
i AS (SELECT *, CASE WHEN mapped = n AND total <= 2147483648 THEN least(most, 4) ELSE most END AS io FROM w)
SELECT l_orderkey, score::BIGINT AS score, CASE WHEN n <= 1 THEN n WHEN most <= 1 THEN most ELSE greatest(1, least(most, greatest(1, (score + 7) // 8), greatest(1, (total + 67108863) // 67108864), greatest(1, 2147483648 // 50331648), CASE WHEN streaming >= 2 THEN least(io, greatest(2, streaming)) ELSE io END)) END::BIGINT AS workers FROM i""")
def worker_count(spark, d):
    method = F.when(F.col("l_linenumber") % 3 == 0, 0).otherwise(8)
    v, memory = F.col("v"), F.lit(2048)
    rows = _virtual(spark, d).withColumns({"mapped": X.mapped_eligible(method, v, memory), "streaming": X.streaming_eligible(method, v) & (v >= 64 * X.MIB), "score": X.parallelism_score(method, v, v, memory)})
    per = rows.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.count_if("mapped").alias("mapped"), F.count_if("streaming").alias("streaming"), F.sum("score").alias("score"))
    workers = X.worker_count(F.col("n"), F.col("score"), F.col("total"), F.col("mapped"), F.col("streaming"), memory, F.lit(X.MIB), F.lit(16), F.lit(16))
    return per.select("l_orderkey", "score", workers.alias("workers"))


_TWISTED = "CASE page_id % 6 WHEN 0 THEN '/' || page_id WHEN 1 THEN 'a\\..\\b' || page_id WHEN 2 THEN 'c:' || page_id WHEN 3 THEN '' WHEN 4 THEN 'a..b/' || page_id ELSE 'x/../' || page_id END"


@query(f"WITH p AS (SELECT page_id, {_TWISTED} AS name FROM pages) SELECT page_id, name = '' OR left(name, 1) IN ('/', '\\') OR (octet_length(encode(left(name, 1))) = 1 AND substr(name, 2, 1) = ':') OR list_contains(regexp_split_to_array(name, '[/\\\\]'), '..') AS unsafe FROM p")
def path_traversal(spark, d):
    i = F.col("page_id").cast("string")
    k = F.col("page_id") % 6
    name = F.when(k == 0, F.concat(F.lit("/"), i)).when(k == 1, F.concat(F.lit("a\\..\\b"), i)).when(k == 2, F.concat(F.lit("c:"), i)).when(k == 3, "").when(k == 4, F.concat(F.lit("a..b/"), i)).otherwise(F.concat(F.lit("x/../"), i))
    return _t(spark, d, "pages").select("page_id", X.unsafe_path(name).alias("unsafe"))


_RECORD = f"(30 + octet_length(encode({PATH})) + {SIZE} + 16)"


@query(f"SELECT doc_id, coalesce(sum({_RECORD}) OVER (PARTITION BY coalesce(source, 'none') ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS local_offset FROM documents")
def header_offsets(spark, d):
    rows = A.plan_entries(_entries(spark, d), profile="store", adaptive=False).drop("content").withColumn("packed", F.col("size"))
    return A.with_offsets(rows).select(F.col("entry_index").alias("doc_id"), F.col("offset").alias("local_offset"))


@query(f"SELECT coalesce(source, 'none') AS source, sum(46 + octet_length(encode({PATH})))::BIGINT AS directory_bytes FROM documents GROUP BY 1")
def central_dir_size(spark, d):
    return _docs(spark, d).groupBy("source").agg(F.sum(X.directory_record_size(F.col("archive_path"), F.lit(0))).alias("directory_bytes"))


@query(f"SELECT {KEYS}, l_orderkey::BIGINT * 7 % 131072 > 65535 OR l_linenumber::BIGINT * 1000000000 > 4294967295 OR {VIRTUAL} > 4294967295 AS needs_zip64 FROM lineitem")
def zip64_needed(spark, d):
    """By any of the three: the number of entries, the size of the directory, its offset."""
    count, size = F.col("l_orderkey") * 7 % 131072, F.col("l_linenumber") * 1000000000
    return _virtual(spark, d).select("l_orderkey", "l_linenumber", X.needs_zip64(count, size, F.col("v")).alias("needs_zip64"))


#: DuckDB has no CRC-32: bytes from hexadecimal digits, and the 256 steps of the reflected polynomial 0xEDB88320
_CRC = """(SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)), lambda a, v: xor(steps[(xor(a, v) & 255) + 1], a >> 8)), 4294967295)::BIGINT AS crc32
FROM documents, (SELECT list(c ORDER BY n) AS steps FROM (SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM (SELECT unnest(range(256))::BIGINT AS n))))"""


@query(f"SELECT doc_id, crc32 FROM {_CRC}")
def crc32_payload(spark, d):
    return _docs(spark, d).select("doc_id", F.crc32("content").alias("crc32"))


def _round(profile: str):
    def run(spark, d):
        rows = _docs(spark, d).withColumn("packed", codecs.zip_deflate("content", F.lit(codecs.LEVELS[profile]), F.lit(0)))
        return rows.select("doc_id", F.decode(codecs.zip_inflate("packed", F.octet_length("content")), "utf-8").alias("text"))

    run.__name__ = f"deflate_roundtrip_{profile}"
    return query("SELECT doc_id, coalesce(text, '') AS text FROM documents")(run)


for _profile in ("fast", "balanced", "small", "maximum"):
    _round(_profile)


@query("SELECT doc_id, coalesce(text, '') AS text FROM documents")
def chunked_roundtrip(spark, d):
    docs = _docs(spark, d)
    chunks = A.chunk_rows(docs, 1024, key="doc_id").withColumn("packed", codecs.zip_deflate_chunk("payload", F.lit(1), F.col("is_last")))
    whole = A.reassembled(chunks, key="doc_id", payload_col="packed")
    sizes = docs.select("doc_id", F.octet_length("content").alias("size"))
    return whole.join(sizes, "doc_id").select("doc_id", F.decode(codecs.zip_inflate("payload", "size"), "utf-8").alias("text"))


@query(f"WITH s AS (SELECT doc_id, {SIZE} AS n FROM documents) SELECT doc_id, k::BIGINT AS chunk_index, least(1024, n - k * 1024)::BIGINT AS raw_size, k = greatest(1, (n + 1023) // 1024) - 1 AS is_last FROM s, unnest(range(greatest(1, (n + 1023) // 1024))) AS t(k)")
def chunk_index_rows(spark, d):
    return A.chunk_rows(_docs(spark, d), 1024, key="doc_id").select("doc_id", "chunk_index", "raw_size", "is_last")


def _named(rows: DataFrame) -> DataFrame:
    return rows.select(F.regexp_extract("name", r"(-?\d+)\.txt$", 1).cast("long").alias("doc_id"), F.decode("content", "utf-8").alias("text"))


@query("SELECT doc_id, coalesce(text, '') AS text FROM documents")
def store_roundtrip(spark, d):
    return _named(A.extract_archives(A.create_archives(_entries(spark, d), profile="store")))


@query("SELECT doc_id, coalesce(text, '') AS text FROM documents")
def archive_extract(spark, d):
    return _named(A.extract_archives(A.create_archives(_entries(spark, d), profile="fast", chunk=65536)))


@query("SELECT doc_id, coalesce(text, '') AS text FROM documents")
def encrypted_roundtrip(spark, d):
    return _named(A.extract_archives(A.create_archives(_entries(spark, d), password="a secret"), password="a secret"))


@query("SELECT 'invalid_job' AS status, count(*) AS n FROM documents")
def wrong_password(spark, d):
    """The verifier is one byte, so a wrong password passes it once in 256 times, and then fails by size or checksum."""
    checks = A.test_archives(A.create_archives(_entries(spark, d), password="a secret"), password="another")
    return checks.groupBy("status").agg(F.count("*").alias("n"))


@query(f"SELECT coalesce(source, 'none') AS archive, (row_number() OVER (PARTITION BY coalesce(source, 'none') ORDER BY doc_id) - 1)::BIGINT AS entry_index, {PATH} AS name, {SIZE} AS size, 8 AS method, 8 AS flag, 'deflate' AS method_name, false AS encrypted, false AS is_directory FROM documents")
def archive_create_list(spark, d):
    listed = A.list_archives(A.create_archives(_entries(spark, d)))
    return listed.select("archive", "entry_index", "name", "size", "method", "flag", "method_name", "encrypted", "is_directory")


@query(f"SELECT {PATH} AS name, 'ok' AS status FROM documents")
def archive_test(spark, d):
    return A.test_archives(A.create_archives(_entries(spark, d))).select("name", "status")


@query(f"SELECT 'file ' || lpad(({SIZE})::VARCHAR, 10, ' ') || ' method=store(0) encrypted=no crc=0x' || lower(lpad(to_hex(crc32), 8, '0')) || ' ' || {PATH} AS line FROM documents JOIN {_CRC} USING (doc_id)")
def archive_list_text(spark, d):
    """The lines of a listing without the packed size, which is the 11 characters after the size."""
    listed = A.list_archives(A.create_archives(_entries(spark, d), profile="store"))
    line = X.list_line(F.col("is_directory"), F.col("size"), F.col("packed"), F.col("method"), F.col("encrypted"), F.col("crc32"), F.col("name"))
    return listed.select(F.concat(F.substring(line, 1, 15), F.substring(line, 27, 1 << 20)).alias("line"))


def _damaged(made: DataFrame) -> DataFrame:
    """Copies of stored archives with the first byte flipped of each entry that isn't empty and whose number 7 divides."""
    folder = A.new_path(made.sparkSession, "damaged")
    fs, root = A.open_shared(folder)
    fs.create_dir(root, recursive=True)
    number = F.regexp_extract("name", r"(-?\d+)\.txt$", 1).cast("long")
    spots = A.list_archives(made).where((number % 7 == 0) & (F.col("size") > 0)).groupBy("archive", "path").agg(F.sort_array(F.collect_list(F.col("offset") + 30 + F.octet_length("name_raw"))).alias("spots"))
    both = made.select("archive", "path").join(spots.select(F.col("archive").alias("of"), "spots"), F.col("archive") == F.col("of"), "left").select("archive", "path", "spots")

    def copy(batches):
        for batch in batches:
            for archive, path, spots in zip(*(c.to_pylist() for c in batch.columns)):
                fs, at = A.open_shared(path)
                to = f"{folder}/{at.rsplit('/', 1)[1]}"
                with fs.open_input_file(at) as source, fs.open_output_stream(A.open_shared(to)[1], compression=None) as out:
                    place, left = 0, list(spots or [])
                    while piece := bytearray(source.read(A.PIECE)):
                        while left and left[0] < place + len(piece):
                            piece[left.pop(0) - place] ^= 1
                        out.write(bytes(piece))
                        place += len(piece)
                yield A.pa.record_batch([A.pa.array([archive]), A.pa.array([to])], ["archive", "path"])

    return A.stored(both.mapInArrow(copy, "archive string, path string"), "damaged")


_BAD = "doc_id % 7 = 0 AND octet_length(encode(coalesce(text, ''))) > 0"


@query(f"SELECT {PATH} AS name, CASE WHEN {_BAD} THEN 'invalid_job' ELSE 'ok' END AS status, CASE WHEN {_BAD} THEN 'crc mismatch while validating: ' || {PATH} END AS message FROM documents")
def archive_test_corrupt(spark, d):
    return A.test_archives(_damaged(A.create_archives(_entries(spark, d), profile="store"))).select("name", "status", "message")


@query(f"""SELECT archive, CASE WHEN n_bad > 0 THEN 'invalid_job' ELSE 'ok' END AS status, CASE WHEN n_bad > 0 THEN 'crc mismatch while validating: ' || first_bad END AS message, files
FROM (SELECT coalesce(source, 'none') AS archive, count(*) AS files, count(*) FILTER ({_BAD}) AS n_bad, arg_min({PATH}, doc_id) FILTER ({_BAD}) AS first_bad FROM documents GROUP BY 1)""")
def first_error(spark, d):
    checks = A.test_archives(_damaged(A.create_archives(_entries(spark, d), profile="store")))
    return A.first_failure(checks).select("archive", "status", "message", "files")


@query("SELECT doc_id, coalesce(text, '') AS text FROM documents")
def archive_zipfile_interop(spark, d):
    """Archives of 64 documents that Python's zipfile writes, read by the engine."""
    folder = A.new_path(spark, "zipfile")
    fs, root = A.open_shared(folder)
    fs.create_dir(root, recursive=True)

    def write(key, table):
        import zipfile

        path = f"{folder}/{key[0].as_py()}.zip"
        with A.open_shared(path)[0].open_output_stream(A.open_shared(path)[1], compression=None) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, body in sorted(zip(table["archive_path"].to_pylist(), table["content"].to_pylist())):
                z.writestr(name, body)
        return A.pa.table({"archive": [str(key[0].as_py())], "path": [path]})

    some = _docs(spark, d).select(F.floor(F.col("doc_id") / 64).alias("of"), "archive_path", "content")
    made = A.stored(some.groupBy("of").applyInArrow(write, "archive string, path string"), "zipfile")
    return _named(A.extract_archives(made))


@query("SELECT doc_id, coalesce(text, '') AS text FROM documents")
def incremental_extract(spark, d):
    """All archives of a folder by the data source, a few entries at a time."""
    datasource.register(spark)
    folder = A.new_path(spark, "folder")
    A.create_archives(_entries(spark, d), folder=folder)
    return _named(spark.read.format("ziparchive").option("entriesPerPartition", "500").load(folder))


@query(f"SELECT {PATH} AS name, CASE WHEN length(coalesce(source, 'none')) % 2 = 0 THEN 1 ELSE 0 END AS flag_bit, length(coalesce(source, 'none')) % 2 = 0 AS encrypted FROM documents")
def encrypted_flags(spark, d):
    """Archives of sources whose name has an even length are encrypted."""
    rows = _entries(spark, d)
    even = F.length("archive") % 2 == 0
    made = A.create_archives(rows.where(even), password="a secret").unionByName(A.create_archives(rows.where(~even)))
    return A.list_archives(made).select("name", F.col("flag").bitwiseAND(F.lit(1)).alias("flag_bit"), "encrypted")


@query("SELECT doc_id, true AS within FROM documents")
def compressed_size_bounds(spark, d):
    n = F.octet_length("content")
    packed = F.octet_length(codecs.zip_deflate("content", F.lit(1), F.lit(0)))
    return _docs(spark, d).select("doc_id", ((packed > 0) & (packed <= n + n / 1000 + 64)).alias("within"))


@query(f"SELECT coalesce(source, 'none') AS source, count(*) AS files, sum({SIZE})::BIGINT AS size, CASE WHEN sum(doc_id) = 0 THEN 100 ELSE sum({SIZE})::BIGINT * 100 // sum(doc_id)::BIGINT END::BIGINT AS expansion FROM documents GROUP BY 1")
def summary_by_source(spark, d):
    """The sum of ids stands for the packed size, since real ones are the codec's own."""
    rows = _docs(spark, d).withColumn("size", F.octet_length("content").cast("long"))
    per = rows.groupBy("source").agg(F.count("*").alias("files"), F.sum("size").alias("size"), F.sum("doc_id").alias("packed"))
    return per.select("source", "files", "size", X.expansion_x100(F.col("size"), F.col("packed")).alias("expansion"))


@query(f"WITH s AS (SELECT doc_id, coalesce(source, 'none') AS source, {SIZE} AS n FROM documents) SELECT doc_id, sum(n) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS done_bytes, count(*) OVER (PARTITION BY source ORDER BY doc_id) AS done_items FROM s")
def progress_events(spark, d):
    """Running sums in blocks of 4096 ids, and over the sums of blocks, so that no source is put in order by one task."""
    rows = _docs(spark, d).select("doc_id", "source", F.floor(F.col("doc_id") / 4096).alias("block"), F.octet_length("content").cast("long").alias("n"))
    blocks = rows.groupBy(F.col("source").alias("s"), F.col("block").alias("b")).agg(F.sum("n").alias("bytes"), F.count("*").alias("items"))
    before = W.partitionBy("s").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("s", "b", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes"), F.coalesce(F.sum("items").over(before), F.lit(0)).alias("items"))
    inside = W.partitionBy("source", "block").orderBy("doc_id").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.select("doc_id", "source", "block", F.sum("n").over(inside).alias("own_bytes"), F.count("*").over(inside).alias("own_items"))
    both = rows.join(blocks, (F.col("source") == F.col("s")) & (F.col("block") == F.col("b")))
    return both.select("doc_id", (F.col("own_bytes") + F.col("bytes")).alias("done_bytes"), (F.col("own_items") + F.col("items")).alias("done_items"))


@query(f"""SELECT {KEYS}, CASE WHEN v >= 1073741824 THEN CASE WHEN v / 1073741824.0 >= 100 THEN printf('%.0f', v / 1073741824.0) ELSE printf('%.1f', v / 1073741824.0) END || ' GB'
WHEN v >= 1048576 THEN CASE WHEN v / 1048576.0 >= 100 THEN printf('%.0f', v / 1048576.0) ELSE printf('%.1f', v / 1048576.0) END || ' MB'
WHEN v >= 1024 THEN CASE WHEN v / 1024.0 >= 100 THEN printf('%.0f', v / 1024.0) ELSE printf('%.1f', v / 1024.0) END || ' KB' ELSE v || ' B' END AS text FROM (SELECT *, {VIRTUAL} AS v FROM lineitem)""")
def format_bytes(spark, d):
    return _virtual(spark, d).select("l_orderkey", "l_linenumber", X.human_bytes(F.col("v")).alias("text"))


@query(f"SELECT source, lang, count(*) AS files, sum(n)::BIGINT AS size FROM (SELECT coalesce(source, 'none') AS source, lang, {SIZE} AS n FROM documents) GROUP BY ROLLUP (source, lang)")
def ext_rollup(spark, d):
    """An extension: archive entries rolled up by source and language."""
    rows = _docs(spark, d).withColumn("size", F.octet_length("content").cast("long"))
    return rows.rollup("source", "lang").agg(F.count("*").alias("files"), F.sum("size").alias("size"))
