"""Mixing sources to target weights by Pareto order sampling.

Every document has a weight within its source; its expected number of copies is that weight times the
source's rate, but at most ``most``. Whole copies are certain. Of what remains, a document has the
inclusion probability p and the rank ``(u / (1 - u)) / (p / (1 - p))`` with a random u (a hash of its id);
each source takes documents in the order of rank until its remaining words are reached as nearly as a
prefix of that order can, so the sample has a fixed size in words.

All of it is DataFrame code. Sources are kept apart by partial aggregates: the place in a source's order
where its words are reached is found by two histograms of the ranks (2 x 512 bins a source), and only rows
of one bin of the finer one, a 262,144th of the source, are sorted. A source with a third of all rows is
never sorted or gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import stored

WORD = r"[^\x20\x09-\x0D]+"
_BITS = 9  #: of a level of the histogram


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[int], share: float, most: int) -> DataFrame:
    """``source, source_size, target`` for (source, source_size), one row each.

    Sources are put in order of code points, null last, and get the weights by turns. ``share`` of all
    words is dealt by weight; what a source would get beyond ``most`` times its size goes to the others
    by weight, until none is above.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights)).cast("int") + 1)
    table = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * most)
    # Sources fill up in the order of cap / weight. Source k is full if the level that fills k and all before it is at most the words there are.
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    table = table.withColumn("full_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("weight_left", F.sum("weight").over(after))
    everything = W.partitionBy(F.lit(1))
    table = table.withColumn("all_words", F.sum("source_size").over(everything) * share)
    table = table.withColumn("level", (F.col("all_words") - F.col("full_before")) / F.col("weight_left"))
    table = table.withColumn("full", F.col("cap") / F.col("weight") <= F.col("level"))
    level = F.min(F.when(~F.col("full"), F.struct("full_before", "level"))).over(everything)["level"]
    return table.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(level * F.col("weight")).alias("target"))


def _expected(rows: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """Adds ``copies``, the expected copies of each row: most, or rate times weight. Weights of a source are few."""
    per = rows.groupBy("source", "weight").agg(F.sum("size").alias("words"))
    per = per.join(targets.select(F.col("source").alias("of"), "target"), F.col("source").eqNullSafe(F.col("of")))
    order = W.partitionBy("source").orderBy(F.col("weight").desc())
    full = F.coalesce(F.sum(F.col("words") * most).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.sum(F.col("words") * F.col("weight")).over(order.rowsBetween(0, W.unboundedFollowing))
    rate = F.when(left > 0, (F.col("target") - full) / left).otherwise(F.lit(0.0))
    per = per.withColumn("rate", rate).withColumn("open", F.col("rate") * F.col("weight") < most)
    rate = F.max_by("rate", F.when(F.col("open"), F.col("weight"))).over(W.partitionBy("source"))
    copies = F.when(F.col("open"), rate * F.col("weight")).otherwise(F.lit(float(most)))
    per = stored(per.select(F.col("source").alias("of"), F.col("weight").alias("by"), copies.alias("copies")), "rates")
    return rows.join(per, F.col("source").eqNullSafe(F.col("of")) & (F.col("weight") == F.col("by"))).drop("of", "by")


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on key and seed only; null is a key too."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def _drawn(rows: DataFrame) -> DataFrame:
    """Adds ``drawn``: whether the sample of its source takes the row. Rows without a rank are never drawn."""
    last = (1 << 2 * _BITS) - 1
    cell = F.least(F.floor(F.col("rank") / (1 + F.col("rank")) * (last + 1)).cast("long"), F.lit(last))
    rows = rows.withColumn("cell", cell).withColumn("coarse", F.shiftright("cell", _BITS))
    order = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)

    def crossed(table: DataFrame, bin_of: str, names: tuple[str, str]) -> DataFrame:
        """For each source, the first bin whose end is past the words that are left, and the words before it."""
        per = table.where("rank is not null").groupBy("source", F.col(bin_of).alias("bin")).agg(F.sum("size").alias("words"), F.first("left").alias("left"))
        per = per.withColumn("sum", F.sum("words").over(order)).where("sum > left")
        at = per.groupBy(F.col("source").alias("of")).agg(F.min(F.struct("bin", (F.col("sum") - F.col("words")).alias("before"))).alias("at"))
        return stored(at.select("of", F.col("at.bin").alias(names[0]), F.col("at.before").alias(names[1])), "crossed")

    def joined(table: DataFrame, at: DataFrame) -> DataFrame:
        return table.join(at, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")

    rows = joined(rows, crossed(rows, "coarse", ("bin1", "words1")))
    inside = rows.where("coarse = bin1").withColumn("left", F.col("left") - F.col("words1"))
    rows = joined(rows, crossed(inside, "cell", ("bin2", "words2")))
    sure = rows.where("not (cell <=> bin2)").withColumn("drawn", F.col("rank").isNotNull() & (F.col("bin1").isNull() | F.coalesce(F.col("cell") < F.col("bin2"), F.lit(False))))
    same = ("source", "rank", "key", "size")
    edge = rows.where("cell = bin2").withColumn("alike", F.sum("size").over(W.partitionBy(*same)))
    upto = F.sum("size").over(W.partitionBy("source").orderBy("rank", F.col("key").asc_nulls_last(), "size").rangeBetween(W.unboundedPreceding, 0))
    edge = edge.withColumn("drawn", upto - F.col("alike") / 2 + F.col("words1") + F.col("words2") <= F.col("left")).drop("alike")
    return sure.unionByName(edge)


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, weight: Column | None = None, seed: int = 17) -> DataFrame:
    """``<id>, source, size, source_size, target, copies`` for each row of ``docs``: how often the mix takes it.

    ``weight`` is a column of ``docs`` that says how much likelier a document is taken than another of
    its source (equal if none is given; null and what isn't above 0 count as 1). It is rounded to two
    significant digits, so that a source has few. A null text has no words and is taken as its
    weight says, at no cost. Null sources are a source, null ids an id. Rows that agree in id, source and
    size share their fate. Sources of no words get a target of 0. An empty table gives none.
    """
    value = F.lit(1.0) if weight is None else F.when(weight > 0, weight).otherwise(1.0).cast("double")
    scale = F.pow(F.lit(10.0), F.floor(F.log10(value)) - 1)
    rows = docs.select(F.col(id_col).alias("key"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.round(F.round(value / scale) * scale, 9).alias("weight"))
    rows = stored(rows, "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes, list(weights), share, most), "targets")
    rows = _expected(rows, targets, most)
    rows = rows.withColumn("whole", F.floor("copies").cast("long")).withColumn("part", F.col("copies") - F.col("whole"))
    rows = stored(rows, "expected")
    u = uniform(F.col("key"), seed)
    certain = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("whole")).alias("sure"))
    named = targets.join(certain.select(F.col("source").alias("of"), "sure"), F.col("source").eqNullSafe(F.col("of"))).select(F.col("source").alias("of"), "source_size", "target", (F.col("target") - F.col("sure")).alias("left"))
    named = stored(named, "left")
    wide = rows.join(named, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    wide = wide.withColumn("rank", F.when(F.col("part") > 0, (u / (1 - u)) / (F.col("part") / (1 - F.col("part")))))
    wide = _drawn(wide)
    return wide.select(F.col("key").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (F.col("whole") + F.col("drawn").cast("long")).alias("copies"))


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as :func:`mix` takes it.

    Null ids, texts and sources are as in :func:`mix`. Rows that agree in id, source and number of words share their fate;
    if their weights differ, that of the one taken most often. Columns may have any names; an empty table gives no rows.
    """
    taken = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    taken = taken.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), "size", "copies").groupBy("id", "source", "size").agg(F.max("copies").alias("copies")).where("copies > 0")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("of"), F.col(source_col).alias("from"), word_count(F.col(text_col)).alias("words"))
    both = rows.join(taken, F.col("of").eqNullSafe(F.col("id")) & F.col("from").eqNullSafe(F.col("source")) & (F.col("words") == F.col("size")))
    return both.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
