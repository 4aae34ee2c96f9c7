"""Benchmark decontamination with suffix arrays of the training documents.

Each task takes its documents in shards of bounded size, builds the suffix array of a shard's words and
searches every suffix of the benchmark in it by bisection, word by word: the range after ``window`` words
holds all places of that window, and the deepest range that is not empty the longest verbatim matches and their
locations. Work and memory follow the lengths of the texts, not the number of pairs of equal places.

Only words of the benchmark can be part of a match, so suffixes that start elsewhere, or in a run of such
words shorter than the shortest window, are left out of the arrays; this loses nothing.

The benchmark is dealt in blocks of at most ``block_bytes`` of text, by size and not by number of items;
one block is broadcast at a time, and every block meets all documents. No task holds more than one shard of
documents (one text, if it is longer), so that hot passages only make some tasks write longer lists.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stored
from .words import slices, thrifty, words

MATCH = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("doc_word", T.LongType()), T.StructField("item_word", T.LongType()), T.StructField("n_words", T.LongType())])


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes, by prefix doubling up to ``depth`` words; 0 ends a suffix."""
    _, rank = np.unique(ids, return_inverse=True)
    rank = rank.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    k = 1
    while k < depth and len(ids):
        after = np.zeros(len(ids), np.int64)
        after[:-k] = rank[k:] + 1 if k < len(ids) else 0
        key = rank * (len(ids) + 2) + after
        order = np.argsort(key, kind="stable")
        placed = key[order]
        rank = np.zeros(len(ids), np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(placed[1:] != placed[:-1])])
        if rank[order[-1]] == len(ids) - 1:
            break
        k *= 2
    return order


def _bisect(text: np.ndarray, order: np.ndarray, depth: int, want: np.ndarray, low: np.ndarray, high: np.ndarray, right: bool) -> np.ndarray:
    """In each range of suffixes, the first whose word at ``depth`` is not below (or is above) the wanted one."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) // 2
        at = order[np.minimum(middle, len(order) - 1)] + depth
        word = np.where(at < len(text), text[np.minimum(at, len(text) - 1)], 0)
        below = (word <= want if right else word < want) & open_
        low, high = np.where(below, middle + 1, low), np.where(open_ & ~below, middle, high)
    return low


@dataclass
class Block:
    """Items as numbers of their distinct words: suffixes are all places of ``text``."""

    names: list[str]
    vocabulary: np.ndarray  #: hashes in ascending order; word k has number k + 1
    text: np.ndarray  #: with a 0 after each item
    item: np.ndarray  #: of each place
    place: np.ndarray  #: within the item
    need: np.ndarray  #: words of the window that starts here, or 0 if none does

    @property
    def shortest(self) -> int:
        return int(self.need[self.need > 0].min(initial=1 << 30))

    @property
    def longest(self) -> int:
        return int(np.bincount(self.item).max(initial=0)) if len(self.item) else 0


def block_of(names: list[str], texts: list[str | None], window: int) -> Block:
    w = words(pa.array(texts, pa.large_string()), "alnum")
    vocabulary = np.unique(w.hash)
    first = w.first
    numbers = np.searchsorted(vocabulary, w.hash) + 1
    text, item, place, need = [], [], [], []
    for k in range(len(names)):
        n = int(first[k + 1] - first[k])
        if n == 0:
            continue
        text += [*numbers[first[k] : first[k + 1]].tolist(), 0]
        item += [k] * (n + 1)
        place += range(n + 1)
        need += [window if p + window <= n else n if p == 0 and n < window else 0 for p in range(n)] + [0]
    return Block(names, vocabulary, *(np.array(x, np.int64) for x in (text, item, place, need)))


@dataclass
class Found:
    """What one block has in some rows: covered spans of words, items, and the longest match at each place, of the rows with any."""

    spans: dict[int, list[tuple[int, int]]]
    items: dict[int, list[str]]
    matches: dict[int, list[tuple[str, int, int, int]]]


def _places(order: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in ranges of a suffix array, and of which range each is."""
    n = high - low
    of = np.repeat(np.arange(len(n)), n)
    return order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], of


def _maximal(matches: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int, int]]:
    """Of matches (item, place in the document, place in the item, words) those that don't lie in another; of equal spans the first."""
    out, reach = [], 0
    for m in sorted(matches, key=lambda m: (m[1], -m[3], m[0], m[2])):
        if m[1] + m[3] > reach:
            out.append(m)
            reach = m[1] + m[3]
    return out


def search(block: Block, w) -> Found:
    """Binary search of every suffix of the block in the suffix array of the words ``w`` of some rows.

    The suffixes of equal windows share one range of the array, so places are listed once for each distinct window
    and not for each pair of places. Suffixes go on until their ranges are empty; a place that leaves a range that
    no suffix keeps whole has its longest match there.
    """
    out = Found({}, {}, {})
    total = len(w.hash)
    if not len(block.text) or not total:
        return out
    at = np.minimum(np.searchsorted(block.vocabulary, w.hash), len(block.vocabulary) - 1)
    known = block.vocabulary[at] == w.hash
    breaks = np.ones(total + 1, bool)
    breaks[1:-1] = ~(known[1:] & known[:-1] & (w.row[1:] == w.row[:-1]))
    edges = np.flatnonzero(breaks)
    lengths = np.diff(edges)
    good = (lengths >= block.shortest) & known[edges[:-1]]
    if not good.any():
        return out
    starts, lengths = edges[:-1][good], lengths[good]
    where = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths[:-1] + 1)]), lengths + 1) + np.arange(int((lengths + 1).sum()))
    ends = np.cumsum(lengths + 1) - 1
    text = at[np.minimum(where, total - 1)] + 1
    text[ends] = 0
    order = suffix_array(text, block.longest)
    alive = np.flatnonzero(block.need > 0)
    low, high = np.zeros(len(alive), np.int64), np.full(len(alive), len(order), np.int64)
    windows, ended = [], []
    first_name = {x: k for k, x in reversed(list(enumerate(block.names)))}
    turn = np.argsort(np.lexsort((block.place, np.array([first_name[x] for x in block.names], np.int64)[block.item])))  # by name and place
    depth = 0
    while len(alive):
        want = block.text[np.minimum(alive + depth, len(block.text) - 1)]  # 0 ends each item
        next_low, next_high = _bisect(text, order, depth, want, low, high, False), _bisect(text, order, depth, want, low, high, True)
        on = (want > 0) & (next_low < next_high)
        some = np.flatnonzero(block.need[alive] <= depth)
        if len(some):  # suffixes with the same range: places that none of them follows further have their longest match
            some = some[np.lexsort((turn[alive[some]], low[some]))]
            head = np.flatnonzero(np.diff(low[some], prepend=-1))
            goes_on = np.logical_or.reduceat((on & (next_high - next_low == high - low))[some], head)
            some = some[head[~goes_on]]
            ended.append((low[some], high[some], np.full(len(some), depth), alive[some]))
        alive, low, high = alive[on], next_low[on], next_high[on]
        depth += 1
        whole = block.need[alive] == depth
        if whole.any():
            windows.append((low[whole], high[whole], np.full(int(whole.sum()), depth), alive[whole]))
    if not windows:
        return out
    first = w.first

    # Words covered by windows, and which windows a row has
    low, high, depths, source = (np.concatenate(x) for x in zip(*windows))
    _, one, same = np.unique(depths * (len(order) + 1) + low, return_index=True, return_inverse=True)  # distinct windows
    place, of = _places(order, low[one], high[one])
    cover = np.zeros(len(text) + 1, np.int64)
    np.add.at(cover, place, 1)
    np.add.at(cover, place + depths[one][of], -1)
    covered = np.cumsum(cover[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]])))
    for a, b in zip(where[edge[::2]].tolist(), where[edge[1::2] - 1].tolist()):
        row = int(w.row[a])
        out.spans.setdefault(row, []).append((a - int(first[row]), b + 1 - int(first[row])))
    pairs = np.unique(np.stack([same, block.item[source]], axis=1), axis=0)  # window, item
    bound = np.searchsorted(pairs[:, 0], np.arange(len(one) + 1))
    held = np.unique(w.row[where[place]] * len(one) + of)
    rows, held = held // len(one), held % len(one)
    cuts = np.flatnonzero(np.diff(rows, prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rows)]):
        mine = np.unique(np.concatenate([pairs[bound[k] : bound[k + 1], 1] for k in held[a:b].tolist()]))
        out.items[int(rows[a])] = sorted({block.names[k] for k in mine.tolist()})

    # The longest match that begins at each place: ranges are nested, and deeper ones are put over the others
    low, high, depths, source = (np.concatenate(x) for x in zip(*ended))
    longest, origin = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    for a, b, n, s in zip(low.tolist(), high.tolist(), depths.tolist(), source.tolist()):  # in the order of depths
        longest[a:b], origin[a:b] = n, s
    by_place = np.zeros((2, len(order)), np.int64)
    by_place[:, order] = longest, origin
    longest, origin = by_place
    before = np.concatenate([[0], longest[:-1]])
    for p in np.flatnonzero(longest > np.maximum(before - 1, 0)).tolist():
        word, s = int(where[p]), int(origin[p])
        row = int(w.row[word])
        out.matches.setdefault(row, []).append((block.names[int(block.item[s])], word - int(first[row]), int(block.place[s]), int(longest[p])))
    return out


def _digest(n_words: np.ndarray, spans: list, items: list, matches: list) -> list[pa.Array]:
    """The result columns of some rows."""
    n_hit, names = [], [sorted(set(x)) for x in items]
    for some in spans:
        end = total = 0
        for low, high in sorted(some):
            total += max(0, high - max(low, end))
            end = max(end, high)
        n_hit.append(total)
    listed = [[dict(zip(MATCH.names, m)) for m in _maximal(x)] for x in matches]
    sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
    return [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()), pa.array(sha, pa.string()), pa.array(listed, _MATCHES)]


RESULT = ["n_words", "n_hit", "n_items", "items_sha256", "matches"]
_MATCHES = pa.list_(pa.struct([("item_id", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())]))
_SPANS = "array<struct<low:bigint,high:bigint>>"
_PART = f"digest string, spans {_SPANS}, items array<string>, matches {T.ArrayType(MATCH).simpleString()}"


def _whole(block, shard_bytes: int):
    """kept and the result columns of all rows, for a benchmark of one block."""

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(1), shard_bytes):
                w = words(batch.column(1).slice(low, high - low), "alnum")
                found = search(block.value, w)
                rows = range(high - low)
                yield pa.record_batch([batch.column(0).slice(low, high - low), *_digest(np.diff(w.first), *([of.get(k, []) for k in rows] for of in (found.spans, found.items, found.matches)))], ["kept", *RESULT])

    return run


def _part(block, shard_bytes: int):
    """What one of several blocks has in the rows with any hit, by the digest of their text."""

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(1), shard_bytes):
                found = search(block.value, words(batch.column(1).slice(low, high - low), "alnum"))
                rows = sorted(found.spans)
                if rows:
                    digest = batch.column(0).slice(low, high - low).take(pa.array(rows))
                    spans = [[{"low": a, "high": b} for a, b in found.spans[k]] for k in rows]
                    matches = [[dict(zip(MATCH.names, m)) for m in found.matches.get(k, [])] for k in rows]
                    yield pa.record_batch([digest, pa.array(spans, pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))), pa.array([found.items[k] for k in rows], pa.list_(pa.string())), pa.array(matches, _MATCHES)], ["digest", "spans", "items", "matches"])

    return run


@thrifty
def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kept and the result columns of all rows, from the parts of all blocks."""
    for batch in batches:
        for low, high in slices(batch.column(1)):
            part = batch.slice(low, high - low)
            blocks = [x or [] for x in part.column(2).to_pylist()]
            spans = [[(y["low"], y["high"]) for x in some for y in x["spans"]] for some in blocks]
            matches = [[tuple(y.values()) for x in some for y in x["matches"]] for some in blocks]
            items = [[y for x in some for y in x["items"]] for some in blocks]
            yield pa.record_batch([part.column(0), *_digest(np.diff(words(part.column(1), "alnum", hashed=False).first), spans, items, matches)], ["kept", *RESULT])


def dealt(items: DataFrame, block_bytes: int) -> tuple[DataFrame, list[list[int]]]:
    """``items`` with a column ``deal``, and the deals of each block: at most ``block_bytes`` of text, or one deal.

    Items are dealt by hash into about eight times as many deals as there must be blocks, and only the sizes of
    deals reach the driver. Equal rows have been removed, so a deal grows with its items only; one item is never cut.
    """
    items = items.distinct()
    size = F.octet_length("text").cast("long") + F.octet_length("name")
    total = items.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    n = 8 * -(-int(total) // block_bytes) if total > block_bytes else 1
    items = items.withColumn("deal", F.pmod(F.xxhash64("name", "text"), F.lit(n)))
    blocks, room = [[]], block_bytes
    for row in sorted(items.groupBy("deal").agg(F.sum(size).alias("size")).collect(), key=lambda r: r.deal):
        if blocks[-1] and row["size"] > room:
            blocks.append([])
            room = block_bytes
        blocks[-1].append(row.deal)
        room -= row["size"]
    return items, blocks


def contamination(docs: DataFrame, benchmark: DataFrame, *, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = 16 << 20, shard_bytes: int = 4 << 20) -> DataFrame:
    """``keep`` (the id, unless given), n_words, n_hit, n_items, items_sha256, matches for each row of ``docs``.

    Words are runs of letters and digits a-z, 0-9 (A-Z lower-cased) and of all characters beyond ASCII.
    ``n_hit`` counts words inside any place of a window of ``window`` item words (of an item with fewer, all
    of it); ``items_sha256`` is of the sorted ids of items that have such a place, joined by commas.
    ``matches`` has the longest verbatim match that begins at each place of the document, unless it lies in a longer
    one: where it begins in the document and in an item (of several with a match as long, that with the
    smallest id, and there the first place), and its words. So it grows with the document, not with the
    number of places that an item's passage has.

    Null and empty texts have no words and no hits; items without words match nothing. A null item id is named "null".
    Rows and items may repeat; other columns don't matter. No documents give no rows, no items no hits.
    A benchmark of one block is one pass over the documents. Of more blocks each is a pass that writes only what
    it found, by the digest of the text, and one join puts it to the documents.
    """
    spark: SparkSession = docs.sparkSession
    keep = [id_col] if keep is None else keep
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("name"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    items, blocks = dealt(items, block_bytes)
    wide = docs.select(F.struct(*[F.col(c) for c in keep]).alias("kept"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([wide.schema["kept"], T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("matches", T.ArrayType(MATCH))])

    def sent(deals: list[int]):
        """One block, of bounded size."""
        rows = (items.where(F.col("deal").isin(deals)) if len(blocks) > 1 else items).orderBy("name", "text").collect()
        return spark.sparkContext.broadcast(block_of([r.name for r in rows], [r.text for r in rows], window))

    if len(blocks) == 1:
        return wide.mapInArrow(_whole(sent(blocks[0]), shard_bytes), schema).select("kept.*", *RESULT)
    wide = wide.withColumn("digest", F.sha2("text", 256))
    parts: DataFrame | None = None
    for k, deals in enumerate(blocks):
        block = sent(deals)
        part = stored(wide.select("digest", "text").mapInArrow(_part(block, shard_bytes), _PART), "part").withColumn("block", F.lit(k))
        block.unpersist()
        parts = part if parts is None else parts.unionByName(part)
    # Equal texts have equal parts, so of each block one is kept, and a text has at most one for each block
    one = parts.groupBy("digest", "block").agg(F.first(F.struct("spans", "items", "matches")).alias("part"))
    every = stored(one.groupBy(F.col("digest").alias("of")).agg(F.collect_list("part").alias("parts")), "parts")
    both = wide.join(every, F.col("digest") == F.col("of"), "left").select("kept", "text", "parts")
    return both.mapInArrow(_merged, schema).select("kept.*", *RESULT)


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, with all their columns.

    Null and empty texts stay, rows that repeat share their fate, columns may have any names, and empty tables
    are as in :func:`contamination`.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("whole"))
    return contamination(rows, benchmark, keep=["row"], text_col="whole", **options).where("n_hit = 0").select("row.*")
