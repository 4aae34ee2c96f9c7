"""The thin queries of the operators in this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship
from . import chat, decontaminate, jaccard, lines, mixing, quality, simple8b, toxicity, urls, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long documents are somewhat likelier: a document's weight is 1 + the bits of its size."""
    docs = _table(spark, sf_dir, "documents")
    weight = F.length(F.bin(mixing.word_count(F.col("text")))).cast("double") + 1
    mixed = mixing.mix(docs, weights=(3, 1, 2), share=1.5, most=2, weight=weight)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    shards = simple8b.write_tokens(docs, tokenizer_path(), end_id=2)
    return simple8b.read_tokens(shards, docs.schema["doc_id"].dataType)


def op6_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def op9_line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_quality(_table(spark, sf_dir, "documents"), max_lost=0.3).drop("lost_share", "cleaned")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicate_classes(_table(spark, sf_dir, "documents"), shingle=4, num=85, den=100)


#: verdict, host, path
URL_RULES = [("allow", "com", ""), ("block", "example.com", "en/"), ("allow", "www.example.com", "en/"), ("block", "net", "es/"), ("block", "net", "fr/")]


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gap in the archives is an error, since they have just been written."""
    pages = _table(spark, sf_dir, "pages")
    read = warc.read_warc(warc.write_warc(pages, least=100), keep_payload=False, strict=True)
    kind = pages.schema["page_id"].dataType
    return read.select(F.col("key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op3_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings: 0 for bad quality, 1 for good but toxic, 2 for good. Kept: at least 1 is likelier than not."""
    labels = _table(spark, sf_dir, "labels")
    ratings = labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("toxic") == 0, 2).alias("grade"))
    return quality.grade_documents(_table(spark, sf_dir, "documents"), ratings, n_grades=3, at_least=1, select=0.5)


def op5_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7)


def op7_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(_table(spark, sf_dir, "conversations"))


def op8_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last number of a page's URL is the id of the document it shows; that document's labels are the page's."""
    pages, labels = _table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels")
    labels = labels.groupBy(F.col("doc_id").alias("of")).agg(((F.min("quality") == 1) & (F.max("toxic") == 0)).cast("int").alias("good"))
    number = F.try_to_number(F.regexp_extract(urls.path_of(F.col("url")), r"(\d{1,18})(?:\.\w+)?/?$", 1), F.lit("9" * 18)).cast("long")
    both = pages.select("page_id", "url", number.alias("of")).join(labels, "of", "left")
    return urls.judge_urls(both, URL_RULES, F.col("good")).drop("template", "purity")


QUERIES = {
    f.__name__: f
    for f in (op1_pareto_mix, op2_warc, op3_ordinal_quality, op4_simple8b, op5_weak_toxicity, op6_suffix_decontamination, op7_snapshot_collapse, op8_path_templates, op9_line_cleaning, op10_jaccard_join)
}
#: op6 lists every window of document words and joins them with those of the items; op7 has one piece for each part, as no part
#: of the tables has more than chat.MOST rows
SQL: dict[str, str] = {
    "op2_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     f AS (SELECT *, strlen(h) AS n, min(page_id) OVER (PARTITION BY h) AS response FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN n >= 100 AND page_id > response THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > response THEN response END AS refers_to
FROM f""",
    "op6_suffix_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     spots AS (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM i WHERE len(w) > 0),
     windows AS (SELECT DISTINCT item, n, array_to_string(w[k : k + n - 1], ' ') AS words FROM spots),
     sizes AS (SELECT DISTINCT n FROM windows),
     places AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n),
     found AS (SELECT doc_id, item, k, p.n AS n FROM (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS words FROM places) p JOIN windows USING (n, words)),
     hits AS (SELECT doc_id, count(DISTINCT word_at) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS word_at FROM found) GROUP BY doc_id),
     items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op7_snapshot_collapse": r"""
WITH t AS (SELECT conv_id, turn, role, text FROM conversations),
     whole AS (SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns, max(turn) AS last_turn FROM t GROUP BY conv_id),
     ends AS (SELECT DISTINCT t.conv_id, t.turn FROM t JOIN whole USING (conv_id) WHERE t.turn < last_turn),
     prefixes AS (SELECT DISTINCT [x FOR x IN turns IF x.turn IS NULL OR x.turn <= ends.turn] AS turns FROM ends JOIN whole USING (conv_id)),
     maximal AS (SELECT min(conv_id) AS conv_id, CAST(len(turns) AS BIGINT) AS n_turns FROM whole ANTI JOIN prefixes USING (turns) GROUP BY turns),
     lines AS (SELECT conv_id, n_turns, CAST(floor(turn / 64) AS BIGINT) AS part, turn, role,
                      '<|im_start|>' || replace(replace(replace(coalesce(role, 'user'), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>'), chr(10), ' ') || chr(10)
                      || replace(replace(coalesce(text, ''), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || '<|im_end|>' || chr(10) AS line
               FROM t JOIN maximal USING (conv_id))
SELECT conv_id, n_turns, part, CAST(0 AS BIGINT) AS piece, count(*) AS n_rows, string_agg(line, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, line) AS rendered
FROM lines GROUP BY conv_id, n_turns, part""",
}
