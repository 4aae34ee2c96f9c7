"""Chat formatting: collapse logged snapshots of growing conversations, then render what is left.

A conversation is its turns in order of ``turn``; turns that share a number count as one set. Its key is the
sum of the 64-bit hashes of (turn, role, text) of all its turns, with two kinds of hash, and its number of
turns; the key of a prefix is the same sum up to a turn. As sums, keys of conversations need only partial
aggregates, and keys of prefixes a running sum. The running sum is taken within blocks of ``BLOCK`` turn
numbers, and over the sums of blocks, so that one conversation with a third of all turns isn't put in
order by one task.

All of it is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import stored

BLOCK = 64  #: turn numbers of a part
MOST = 4096  #: rows of a part
_KEY = ("h1", "h2", "n")


def _turns(table: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, turn, role, text, block, h1, h2: one row each."""
    turn, role, text = F.col(turn_col).cast("long"), F.col(role_col).cast("string"), F.col(text_col).cast("string")
    none = lambda c: c.isNull().cast("int")  # noqa: E731  # hash functions skip nulls, so these are told apart
    parts = [turn, none(turn), role, none(role), text, none(text)]
    word = lambda salt: F.xxhash64(F.lit(salt), *parts)
    # 32 bits of a hash at most, so that sums of two billion turns stay in range: four sums make up 128 bits
    low, high = (lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))), (lambda h: F.shiftrightunsigned(h, 32))
    rows = table.select(F.col(conv_col).alias("conv"), turn.alias("turn"), role.alias("role"), text.alias("text"), word("a").alias("wa"), word("b").alias("wb"))
    return rows.select("conv", "turn", "role", "text", F.floor(F.col("turn") / BLOCK).cast("long").alias("block"), F.array(low(F.col("wa")), high(F.col("wa")), low(F.col("wb")), high(F.col("wb"))).alias("h"))


def _sums() -> list[Column]:
    return [F.sum(F.col("h")[k]).alias(f"s{k}") for k in range(4)] + [F.count("*").alias("n")]


_PARTS = ("s0", "s1", "s2", "s3", "n")


def _keyed(table: DataFrame) -> DataFrame:
    """Folds the sums into the key columns h1, h2, n."""
    return table.withColumn("h1", F.xxhash64(F.lit(1), *_PARTS[:4])).withColumn("h2", F.xxhash64(F.lit(2), *_PARTS[:4])).drop(*_PARTS[:4])


def maximal_conversations(table: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``<conv>, n_turns`` of the conversations that aren't a prefix of a longer one; of equal ones, the smallest id.

    Nulls are values of their own in all columns; a null conversation id is a conversation, and stays if no
    other id has the same turns. Rows that repeat count. An empty table gives no rows.
    """
    turns = _turns(table, conv_col, turn_col, role_col, text_col)
    whole = _keyed(turns.groupBy("conv").agg(*_sums()))
    whole = whole.groupBy(*_KEY).agg(F.min("conv").alias("conv"))
    # Prefixes end with each distinct turn number but the last of their conversation
    steps = turns.groupBy("conv", "block", "turn").agg(*_sums())
    blocks = turns.groupBy("conv", "block").agg(*_sums(), F.max("turn").alias("last"))
    before = W.partitionBy("conv").orderBy(F.col("block").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy("conv").orderBy(F.col("block").asc_nulls_first()).rowsBetween(1, W.unboundedFollowing)
    blocks = blocks.select(F.col("conv").alias("c"), F.col("block").alias("b"), F.col("last"), (F.count("*").over(after) > 0).alias("more"), *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}_before") for x in _PARTS])
    within = W.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    running = steps.select("conv", "block", "turn", *[F.sum(x).over(within).alias(x) for x in _PARTS])
    both = running.join(blocks, F.col("conv").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b")))
    ends = both.where(F.col("more") | ~F.col("turn").eqNullSafe(F.col("last")))
    prefixes = _keyed(ends.select(*[(F.col(x) + F.col(f"{x}_before")).alias(x) for x in _PARTS])).select(*_KEY).distinct()
    left = whole.join(prefixes, list(_KEY), "left_anti")
    return left.select(F.col("conv").alias(conv_col), F.col("n").alias("n_turns"))


def render(table: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", opening: str = "<|im_start|>", closing: str = "<|im_end|>", default_role: str = "user") -> DataFrame:
    """``<conv>, n_turns, part, piece, n_rows, rendered`` of the maximal conversations.

    Each turn becomes ``opening role newline text closing newline``, in order of turn, role and text. A part holds
    the turns of ``BLOCK`` turn numbers, so that no row grows with a conversation. If more than ``MOST`` rows share
    a part, as where turn numbers repeat or are null, each of its turn numbers is dealt into pieces of about ``MOST`` rows at
    most, by the rows' places in the input. Parts, and their pieces, in order, joined without anything between, are
    the conversation.

    Delimiters inside texts and roles are broken up with a space, and line ends in roles become spaces, so that
    neither can open or close a turn. A null role becomes ``default_role``, a null text is empty. Turns without a
    number come first, in a part with a null number. Columns may have any names; an empty table gives no rows.
    """
    kept = maximal_conversations(table, conv_col=conv_col, turn_col=turn_col, role_col=role_col, text_col=text_col)
    turns = _turns(table, conv_col, turn_col, role_col, text_col)

    def safe(x: Column) -> Column:
        for mark in (opening, closing):
            x = F.replace(x, F.lit(mark), F.lit(f"{mark[0]} {mark[1:]}"))
        return x

    role = F.replace(safe(F.coalesce(F.col("role"), F.lit(default_role))), F.lit("\n"), F.lit(" "))
    line = F.concat(F.lit(opening), role, F.lit("\n"), safe(F.coalesce(F.col("text"), F.lit(""))), F.lit(closing + "\n"))
    kept = kept.select(F.col(conv_col).alias("c"), "n_turns")
    mine = turns.join(kept, F.col("conv").eqNullSafe(F.col("c"))).withColumn("line", line).select("conv", "n_turns", "block", "turn", "role", "line")
    per_turn = turns.groupBy("conv", "block", "turn").agg(F.count("*").alias("n"))
    large = per_turn.groupBy(F.col("conv").alias("of"), F.col("block").alias("in")).agg(F.sum("n").alias("all")).where(F.col("all") > MOST)
    large = stored(per_turn.join(large, F.col("conv").eqNullSafe(F.col("of")) & F.col("block").eqNullSafe(F.col("in"))).select(F.col("conv").alias("of"), F.col("turn").alias("at"), "n"), "large")
    piece = F.lit(0).cast("long")
    if large.limit(1).count():  # only then are the turns joined with these
        mine = mine.withColumn("place", F.monotonically_increasing_id()).join(large, F.col("conv").eqNullSafe(F.col("of")) & F.col("turn").eqNullSafe(F.col("at")), "left")
        within = F.coalesce(F.col("turn") - F.col("block") * BLOCK, F.lit(0)) * (1 << 40) + F.pmod(F.xxhash64("place"), F.ceil(F.col("n") / MOST))
        piece = F.when(F.col("n").isNull(), piece).otherwise(within)
    parts = mine.groupBy("conv", "n_turns", "block", piece.alias("piece")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "line"))).alias("lines"))
    return parts.select(F.col("conv").alias(conv_col), "n_turns", F.col("block").alias("part"), "piece", F.size("lines").cast("long").alias("n_rows"), F.array_join(F.col("lines.line"), "").alias("rendered"))
