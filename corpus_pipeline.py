"""A corpus pipeline: toxic documents go, one of each near-duplicate group stays, benchmark passages go, sources are mixed, ids are written.

Stages take (spark, docs, sf_dir) and return a DataFrame that is written as Parquet and read again as the next one's
docs; all but the last return the columns of ``documents``. Every stage works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parcelyard.llm import decontaminate, jaccard, mixing, simple8b, toxicity
from parcelyard.llm.queries import tokenizer_path
from parcelyard.ship import ship
from parcelyard.storage import Stored, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that score 0.7 or more. Labels are those of the table, outside of the held-out fold."""
    return toxicity.without_toxic(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by five-word shingles at a similarity of 0.8."""
    ship(spark)
    return jaccard.keep_one_of_each(docs, shingle=5, num=80, den=100)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold 10 consecutive words of a benchmark item, or all of a shorter one."""
    return decontaminate.decontaminated(docs, ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of the mix: 150 % of all words, sources at weights 3, 1, 2 by turns, each document up to twice."""
    ship(spark)
    return mixing.mixed_documents(docs, weights=(3, 1, 2), share=1.5, most=2)


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document of the token files: doc_id, start, n_tokens, ids_crc32."""
    ship(spark)
    shards = simple8b.write_tokens(docs, tokenizer_path(), end_id=2)
    return simple8b.read_tokens(shards, docs.schema["doc_id"].dataType)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_benchmark), ("mixing", mix_sources), ("token_ids", write_ids)]

#: None: a trained classifier and a tokenizer are stages that SQL can't express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Tables in between are deleted as soon as the next stage is written; the token files stay."""
    docs, before = ship(spark).read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch():
            now = Stored(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
        if before is not None:
            before.drop()
        docs, before = now.df, now
    return docs
