"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Two documents link when ``den * |A & B| >= num * |A | B|`` for their sets of distinct word n-grams. If
all n-grams are put into one order, a linked pair shares one within the first ``n - ceil(n * num / den)
+ 1`` of each set. The order here is rare first: by document frequency, then by hash.

Filters of a pair that shares a prefix n-gram at places x and y of the two ordered sets:

* length: the smaller set must be large enough;
* position: what follows x and y must be enough for the overlap that is needed;
* suffix: the line of all ordered n-grams is cut by 63 pivots into cells of about as many n-grams each, and every
  set has its number of n-grams in each cell. What follows x and y can overlap by the smaller number in each cell at most, and
  what comes before by the smaller of x and y. The pivots are the same for all sets, so no text is needed.

How it scales:

* Frequencies are counted over all documents in a sketch of ``2**SKETCH_BITS`` counters (hashed, so
  never too low). Its size is fixed, so its logarithms can be broadcast (1 MB). Any counts give right
  results; good ones keep passages that many documents share out of the prefixes.
* Where the sketch is too coarse to tell n-grams that many documents share, exact counts take its place: prefix n-grams are
  counted by their buckets, and if those of documents that aren't linked would still make many pairs, the most frequent
  ``LISTED`` of them are put last in the order, by their counts, and prefixes are made anew.
* Documents with equal sets become one node, by partial aggregation, before any pair is made.
* Of prefix n-grams that two or more nodes share, one node is the centre, that with the most shared grams,
  and is paired with the others (as many pairs as rows, not its square). After those are verified, the
  centre of the most frequent component is paired with the nodes of others, and so on. At the end only
  pairs of different components are left to be made, and in each bucket only by nodes outside of the
  component that is the most frequent there. So a bucket that holds one large group of near copies makes no pairs within the group,
  and every link between nodes of different components is still found.
* Pairs are joined with the text of the node first and with that of the centre last, so that a centre's text is not
  moved once for each of its pairs. Verification holds ``VERIFY_BYTES`` of texts, or one pair, at a time.
* All joins are plain equi-joins of shuffled tables, which adaptive execution splits when a key is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import Stored, stored
from .words import U64, gram_sets, mix, slices, thrifty, words

SKETCH_BITS = 20
_CHUNK = 1 << 14
#: up to so many documents to be fetched again their ids are broadcast (8 bytes each); beyond, they are joined
BROADCAST_IDS = 500_000
_LANES = 64
CELLS = 64  #: of the suffix filter
LISTED = 1 << 18  #: n-grams with exact counts that are broadcast, at most (10 bytes each)
VERIFY_BYTES = 8 << 20
#: candidates for each node that the last step may have, before length and place are looked at, until prefixes are made anew with exact counts
PAIRS_EACH = 256


def _sketch_of(shingle: int, bits: int):
    size, chunk = 1 << bits, min(_CHUNK, 1 << bits)

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            text = batch.column(0)
            for low, high in slices(text):
                _, grams = gram_sets(words(text.slice(low, high - low)), shingle)
                counts += np.bincount((grams >> U64(64 - bits)).astype(np.int64), minlength=size)
        lane = TaskContext.get().partitionId()
        if counts.any():
            small = np.minimum(counts, np.iinfo(np.uint32).max).astype(np.uint32)
            yield pa.record_batch([pa.array(range(size // chunk), pa.int32()), pa.array([lane] * (size // chunk), pa.int64()), pa.array([small[k : k + chunk].tobytes() for k in range(0, size, chunk)], pa.binary())], ["chunk", "lane", "counts"])

    return run


def _merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the counters of one chunk and lane, batch by batch."""
    total = np.zeros(1, np.uint64)
    for batch in batches:
        for x in batch.column(batch.schema.get_field_index("counts")):
            total = total + np.frombuffer(x.as_buffer(), np.uint32)
    top = np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32)
    yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64()), pa.array([top.tobytes()], pa.binary())], ["chunk", "lane", "counts"])


def frequencies(texts: DataFrame, shingle: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """Document frequency of n-grams by the top bits of their hash."""
    schema = "chunk int, lane long, counts binary"
    lanes = max(1, texts.rdd.getNumPartitions())
    table = texts.mapInArrow(_sketch_of(shingle, bits), schema)
    while lanes > 1:  # as a tree, so that no task merges more than _LANES pieces of a chunk
        lanes = -(-lanes // _LANES)
        table = table.withColumn("lane", F.col("lane") % lanes).groupBy("chunk", "lane").applyInArrow(_merge, schema)
    counts, chunk = np.zeros(1 << bits, np.uint32), min(_CHUNK, 1 << bits)
    for row in table.toLocalIterator():
        counts[row.chunk * chunk : (row.chunk + 1) * chunk] += np.frombuffer(row.counts, np.uint32)
    return counts


class Order:
    """One order of all n-grams: by rank, then by hash; and the cell of each on its line.

    The rank is the logarithm (base 2**0.125) of the counter, or for a listed n-gram, after all others, of its
    own count. Ranks share the line by the n-grams they stand for, and hashes share a rank's part evenly, so
    that cells hold about as many n-grams each.
    """

    def __init__(self, counts: np.ndarray, listed: np.ndarray, listed_counts: np.ndarray):
        self.bits = len(counts).bit_length() - 1
        self.rank = self._log(counts).astype(np.uint8)
        turn = np.argsort(listed)
        self.listed, self.listed_rank = listed[turn], 256 + self._log(listed_counts[turn]).astype(np.uint16)
        share = np.bincount(self.rank, counts, 512) + np.bincount(self.listed_rank, listed_counts[turn], 512)
        share = share / max(share.sum(), 1)
        self.share, self.ends = share, np.concatenate([[0.0], np.cumsum(share)])

    @staticmethod
    def _log(counts: np.ndarray) -> np.ndarray:
        return np.minimum(np.round(8 * np.log2(np.maximum(counts, 1))), 255)

    def of(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and cell; cells never fall in the order of (rank, hash)."""
        rank = self.rank[(grams >> U64(64 - self.bits)).astype(np.int64)].astype(np.int64)
        if len(self.listed):
            at = np.minimum(np.searchsorted(self.listed, grams), len(self.listed) - 1)
            rank = np.where(self.listed[at] == grams, self.listed_rank[at], rank)
        place = self.ends[rank] + self.share[rank] * (grams.astype(np.float64) / 2.0**64)
        cell = np.clip(place, self.ends[rank], self.ends[rank + 1]) * CELLS  # sums of shares may be rounded
        return rank, np.minimum(cell.astype(np.int64), CELLS - 1)


def _nodes_of(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set."""
    lengths = np.diff(bounds)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(grams), dtype=U64)])
    return mix((sums[bounds[1:]] - sums[bounds[:-1]]) * U64(0x9E3779B97F4A7C15) + lengths.astype(U64)).view(np.int64)


def _signatures(shingle: int, num: int, den: int, order, id_type: pa.DataType):
    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            for low, high in slices(text):
                bounds, grams = gram_sets(words(text.slice(low, high - low)), shingle)
                rank, cell = order.value.of(grams)
                row = np.repeat(np.arange(high - low), np.diff(bounds))
                cells = np.minimum(np.bincount(row * CELLS + cell, minlength=CELLS * (high - low)), 65535).astype(np.uint16).reshape(-1, CELLS)
                parts = []
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    n = b - a
                    head = np.argsort(rank[a:b], kind="stable")[: n + (-n * num) // den + 1 if n else 0]
                    parts.append(grams[a:b][head])
                sizes = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
                flat = np.concatenate(parts) if parts else np.zeros(0, U64)
                yield pa.record_batch(
                    [
                        batch.column(0).slice(low, high - low).cast(id_type),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array(_nodes_of(grams, bounds), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat.view(np.int64), pa.int64())),
                        pa.array([x.tobytes() for x in cells], pa.binary()),
                    ],
                    ["id", "n", "node", "prefix", "cells"],
                )

    return run


def overlap_bound(x: np.ndarray, y: np.ndarray, at_x: np.ndarray, at_y: np.ndarray) -> np.ndarray:
    """The most n-grams that two sets can share, by their cells (a row each) and the places of one that they do share.

    A cell that is full (65535) may stand for more, and then nothing is known of the suffix behind it.
    """

    def behind(cells: np.ndarray, at: np.ndarray) -> np.ndarray:
        upto = np.maximum(np.cumsum(cells, axis=1) - (at + 1)[:, None], 0)
        return np.diff(upto, axis=1, prepend=0)

    suffix = np.minimum(at_x, at_y) + 1 + np.minimum(behind(x, at_x), behind(y, at_y)).sum(axis=1)
    whole = np.minimum(x, y).sum(axis=1)
    full = (x == 65535).any(axis=1) | (y == 65535).any(axis=1)
    return np.where(full, np.iinfo(np.int64).max // 1000, np.minimum(suffix, whole))


def _suffix_filter(num: int, den: int):
    """Keeps pairs whose sets can still overlap enough."""

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, at_a, at_b, na, nb = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
            x, y = (np.frombuffer(b"".join(v.as_py() for v in batch.column(k)), np.uint16).reshape(-1, CELLS).astype(np.int64) for k in (6, 7))
            keep = overlap_bound(x, y, at_a, at_b) * (num + den) >= num * (na + nb)
            yield pa.record_batch([pa.array(a[keep], pa.int64()), pa.array(b[keep], pa.int64())], ["a", "b"])

    return run


def _packed(shingle: int):
    """node and compressed text of documents."""

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            text = batch.column(0)
            for low, high in slices(text):
                part = text.slice(low, high - low)
                bounds, grams = gram_sets(words(part), shingle)
                yield pa.record_batch([pa.array(_nodes_of(grams, bounds), pa.int64()), pa.array([squeeze.compress((x.as_py() or "").encode()) for x in part], pa.binary())], ["node", "packed"])

    return run


def _verify(shingle: int, num: int, den: int):
    """Rows are a, b, text of a, text of b. A text of a that stands in several rows in a row is expanded once."""

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()

        def grams_of(packed: list[bytes]) -> list[np.ndarray]:
            bounds, grams = gram_sets(words(pa.array([expand.decompress(x).decode() for x in packed], pa.large_string())), shingle)
            return [grams[low:high] for low, high in zip(bounds[:-1], bounds[1:])]

        last, held = None, np.zeros(0, U64)
        for batch in batches:
            low = 0
            while low < len(batch):
                high, size = low, 0
                while high < len(batch) and high - low < 256 and (high == low or size < VERIFY_BYTES):
                    size += sum(zstandard.frame_content_size(batch.column(k)[high].as_py()) for k in (2, 3))
                    high += 1
                part = batch.slice(low, high - low)
                low = high
                names = part.column(0).to_pylist()
                heads = [k for k in range(len(part)) if k == 0 or names[k] != names[k - 1]]
                fresh = [k for k in heads if k or names[0] != last]
                made = dict(zip(fresh, grams_of([part.column(2)[k].as_py() for k in fresh])))
                keep = []
                for k, y in enumerate(grams_of([x.as_py() for x in part.column(3)])):
                    held = made.pop(k, held)
                    last = names[k]
                    both = len(held) + len(y) - len(np.union1d(held, y))
                    keep.append(den * both >= num * (len(held) + len(y) - both) and both > 0)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(keep, pa.bool_())], ["a", "b", "linked"])

    return run


class _Join:
    """The tables of one join and what has been verified so far."""

    def __init__(self, docs: DataFrame, shingle: int, num: int, den: int, bits: int = SKETCH_BITS):
        self.docs, self.shingle, self.num, self.den = docs, shingle, num, den
        self.temporary: list[Stored] = []
        self.counts = frequencies(docs.select("text"), shingle, bits)
        self.listed: dict[int, int] = {}  #: hash and count of the n-grams that are put last
        self.texts: list[DataFrame] = []
        self.tested: DataFrame | None = None
        self.edges: DataFrame | None = None
        self.n_pairs = 0  #: that were verified
        self.labelled: tuple[DataFrame, DataFrame] | None = None  #: what :meth:`mixed` gives, as long as no link is added
        self.candidates: int | None = None  #: of the last step, when it was last counted
        self.sign()

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """A table that goes when the join is done."""
        self.temporary.append(Stored(df, name))
        return self.temporary[-1].df

    def drop(self) -> None:
        for x in self.temporary:
            x.drop()
        self.temporary.clear()

    def sign(self) -> None:
        """Rows, nodes and entries by the order as it is known."""
        from pyspark.sql.pandas.types import to_arrow_type

        spark, id_field = self.docs.sparkSession, self.docs.schema["id"]
        order = spark.sparkContext.broadcast(Order(self.counts, np.array(list(self.listed), np.int64).view(U64), np.array(list(self.listed.values()), np.int64)))
        schema = f"id {id_field.dataType.simpleString()}, n long, node long, prefix array<long>, cells binary"
        sets = Stored(self.docs.mapInArrow(_signatures(self.shingle, self.num, self.den, order, to_arrow_type(id_field.dataType)), schema), "sets")
        if not self.listed:
            self.rows = self.stored(sets.df.select("id", "n", "node"), "rows")
        self.nodes = self.stored(sets.df.where("n > 0").groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("cells").alias("cells")), "nodes")
        sets.drop()
        entries = self.nodes.select("node", "n", F.posexplode("prefix").alias("at", "gram"))
        shared = entries.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1")
        found = Stored(entries.join(shared, "gram"), "shared")
        # A node whose grams many others have is likely what they were copied from
        weight = found.df.groupBy("node").agg(F.sum("m").alias("weight"))
        self.entries = self.stored(found.df.drop("m").join(weight, "node").select("gram", "node", "n", "at", "weight"), "entries")  #: of grams that several nodes have
        found.drop()
        self.labelled = None

    def near(self, x: str, y: str):
        """Length filter, and the positional filter for a gram that x and y share."""
        nx, ny, ax, ay = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.at"), F.col(f"{y}.at")
        length = F.least(nx, ny) * self.den >= F.greatest(nx, ny) * self.num
        most = F.least(nx - ax, ny - ay)
        return length & (most * (self.num + self.den) >= (nx + ny) * self.num)

    def test(self, both: DataFrame) -> bool:
        """Verify each of the pairs (centre y, node x) once; adds to ``edges``, and says whether there were any links."""
        rows = both.select(F.col("y.node").alias("a"), F.col("x.node").alias("b"), F.col("y.at").alias("at_a"), F.col("x.at").alias("at_b"))
        # The first of the grams that a pair shares has the smallest places in both sets
        rows = rows.groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.min(F.struct("at_a", "at_b", "a", "b")).alias("one"))
        if self.tested is not None:
            rows = rows.join(self.tested, ["low", "high"], "left_anti")
        side = lambda c: self.nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("cells").alias(f"cells{c}"))
        wide = rows.select("one.*").join(side("b"), "b").join(side("a"), "a").select("a", "b", F.col("at_a").cast("long"), F.col("at_b").cast("long"), "na", "nb", "cellsa", "cellsb")
        pairs = self.stored(wide.mapInArrow(_suffix_filter(self.num, self.den), "a long, b long"), "pairs")
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        for have in self.texts:
            wanted = wanted.join(have, "node", "left_anti")
        ids = self.stored(wanted.join(self.nodes, "node").select(F.col("id").alias("wanted")).distinct(), "wanted")
        n = ids.count()
        if n:
            found = self.docs.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, F.col("id").eqNullSafe(F.col("wanted")), "left_semi")
            self.texts.append(self.stored(found.select("text").mapInArrow(_packed(self.shingle), "node long, packed binary").groupBy("node").agg(F.first("packed").alias("packed")), "texts"))
        texts = None
        for x in self.texts:
            texts = x if texts is None else texts.unionByName(x)
        if texts is None:
            return False
        left, right = (texts.select(F.col("node").alias(c), F.col("packed").alias(f"packed{c}")) for c in "ab")
        both = pairs.join(right, "b").join(left, "a").select("a", "b", "packeda", "packedb")
        done = self.stored(both.mapInArrow(_verify(self.shingle, self.num, self.den), "a long, b long, linked boolean"), "verified")
        pair = done.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
        self.tested = pair if self.tested is None else self.tested.unionByName(pair)
        made = done.agg(F.count("*").alias("n"), F.count_if("linked").alias("linked")).first()
        self.n_pairs += made.n
        if made.linked:
            edges = done.where("linked").select("a", "b")
            self.edges = edges if self.edges is None else self.edges.unionByName(edges)
            self.labelled = None
        return made.linked > 0

    def mixed(self) -> tuple[DataFrame, DataFrame]:
        """Entries, with labels, of buckets that hold several components; and each such bucket's most frequent label and its centre."""
        if self.labelled is not None:  # no link has come since
            return self.labelled
        if self.edges is None:
            entries = self.entries.withColumn("label", F.col("node"))
        else:
            entries = self.stored(self.entries.join(components(self.edges), "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
        per = entries.groupBy("gram", "label").agg(F.count("*").alias("m"), F.max(F.struct("weight", "node", "n", "at")).alias("centre"))
        main = per.groupBy("gram").agg(F.max(F.struct("m", "centre.weight", "label", "centre")).alias("top"), F.count("*").alias("labels"), F.sum("m").alias("all")).where("labels > 1")
        main = self.stored(main.select("gram", F.col("top.label").alias("main"), F.col("top.centre").alias("centre"), "all", (F.col("all") - F.col("top.m")).alias("few")), "main")
        self.labelled = entries, main
        return self.labelled

    def stars(self, rounds: int = 3) -> None:
        """Pairs of the centre of each bucket's main component with the nodes of others; again, while that joins more."""
        for _ in range(rounds):
            entries, main = self.mixed()
            centre = main.select("gram", "main", "centre.node", "centre.n", "centre.at")
            if not self.test(entries.alias("x").join(centre.alias("y"), "gram").where((F.col("x.label") != F.col("y.main")) & self.near("x", "y"))):
                return

    def list_frequent(self) -> bool:
        """Whether the last step would make many pairs and there are n-grams to be put last for it; lists those.

        It is done again as long as that halves the candidates. Whatever is left is paired in full by :meth:`rest`.
        """
        _, main = self.mixed()
        size = main.agg(F.coalesce(F.sum(F.col("few") * F.col("all")), F.lit(0)).alias("pairs")).first().pairs
        if size <= PAIRS_EACH * self.nodes.count() or self.candidates is not None and 2 * size > self.candidates:
            return False
        self.candidates = size
        room = LISTED - len(self.listed)
        top = main.where(F.col("few") * F.col("all") > PAIRS_EACH).orderBy((F.col("few") * F.col("all")).desc(), "gram").limit(max(room, 0)).select("gram", "all").toArrow()
        new = {g: n for g, n in zip(top["gram"].to_pylist(), top["all"].to_pylist()) if g not in self.listed}
        self.listed |= new
        return bool(new)

    def rest(self) -> None:
        """All pairs of entries in a bucket that are still of different components."""
        entries, main = self.mixed()
        mixed = self.stored(entries.join(main.select("gram", "main"), "gram"), "mixed")
        few = mixed.where("label <> main").alias("x")
        self.test(few.join(mixed.alias("y"), (F.col("x.gram") == F.col("y.gram")) & (F.col("x.label") != F.col("y.label")) & self.near("x", "y")))

    def every(self) -> None:
        """All pairs of entries in a bucket, whatever their components."""
        self.test(self.entries.alias("x").join(self.entries.alias("y"), (F.col("x.gram") == F.col("y.gram")) & (F.col("x.node") < F.col("y.node")) & self.near("x", "y")))


def near_duplicate_links(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``set_a, set_b, id_a, id_b`` for each link between two different sets: their keys and the smallest id of each.

    These are all links, those inside a component included, so a bucket of m sets makes up to m * (m - 1) / 2
    pairs. Documents with equal sets are one set; words and n-grams are those of ``near_duplicate_classes``.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    join = _Join(source, shingle, num, den)
    join.every()
    side = lambda c: join.nodes.select(F.col("node").alias(c), F.col("id").alias(f"id_{c}"))
    edges = join.nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0) if join.edges is None else join.edges
    out = stored(edges.join(side("a"), "a").join(side("b"), "b").select(F.col("a").alias("set_a"), F.col("b").alias("set_b"), "id_a", "id_b"), "links")
    join.drop()
    return out


def near_duplicate_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``<id>, n_shingles, component_id`` for each document: its set's size, and the smallest id it can reach by links.

    Words are what lies between ASCII white space, with A-Z lower-cased; n-grams are hashed to 64 bits. A
    text of fewer words than ``shingle`` is one n-gram; null and white space have none, link with nothing
    and are their own component. Repeated ids give a row each. A null id stays null and does not name a
    component unless all ids in it are null. Other columns are ignored, an empty table gives no rows.
    Links inside a component are verified only as far as they join it; ``near_duplicate_links`` has all.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    join = _Join(source, shingle, num, den)
    join.stars()
    while join.list_frequent():
        join.sign()
        join.stars(1)
    join.rest()
    ids = join.nodes.select("node", "id")
    if join.edges is not None:
        labelled = join.stored(ids.join(components(join.edges), "node").select("node", "label", "id"), "classes")
        smallest = labelled.groupBy("label").agg(F.min("id").alias("component_id"))
        named = labelled.join(smallest, "label").select("node", "component_id")
        ids = ids.join(named, "node", "left").select("node", F.coalesce("component_id", "id").alias("component_id"))
    else:
        ids = ids.withColumnRenamed("id", "component_id")
    linked = join.rows.where("n > 0").join(ids, "node").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    alone = join.rows.where("n = 0").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    out = stored(linked.unionByName(alone), "classes")
    join.drop()
    return out


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their near-duplicate class, with all their columns.

    Rows that repeat an id are all kept if that id is; rows with a null id, and rows without words, are kept.
    Columns may have any names; an empty table gives no rows.
    """
    classes = near_duplicate_classes(docs, id_col=id_col, text_col=text_col, shingle=shingle, num=num, den=den)
    gone = classes.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("gone")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("of"))
    return rows.join(gone, F.col("of") == F.col("gone"), "left_anti").select("row.*")
