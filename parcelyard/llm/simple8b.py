"""Token ids in Simple-8b files.

Coding: a block holds up to ``BLOCK`` ids in 64-bit little-endian words. The top 4 bits of a word select
how many ids it packs at how many bits; as many as fit are taken. Ids of more than 60 bits are escapes: 0
stands in the words, and place and value follow the block's words.

A shard file is ::

    "S8TOKEN1" | words of all blocks | escapes: (index, value) u64 pairs | directory | footer
    directory: offset of each block's first word u64 | ids of each document u32 | keys of the documents (a JSON array)
    footer: n_ids, n_blocks, n_words, n_escapes, n_documents, key_bytes u64 | crc32 of all before u32 | "S8END..."

Blocks start at every ``BLOCK``-th id of the shard, so block k and the ids of any document are found from
the directory alone, and all blocks are coded and decoded at once with NumPy: step j packs the j-th word of
every block, and decoding unpacks all words that have the same selector.

Documents are dealt to tasks by ranges of ids. Each task writes its shards (of bounded size) under names of
its own attempt, and returns a row for each; only shards in the table of these rows, which is written
once, are part of the file set. So a task that is run again leaves at most an unused file behind.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import new_path, open_shared, stored
from .words import U64, raw, slices, thrifty

#: (ids, bits) of each selector: fixed values of the coding
SELECTORS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
COUNTS = np.array([n for n, _ in SELECTORS])
BLOCK = 256
#: the least width of a selector that holds ids of so many bits
_WIDTHS = np.array([min(b for _, b in SELECTORS if b >= min(n, 60)) for n in range(62)], np.uint8)
_AT_ONCE = 4096 * BLOCK  #: ids that are coded at once
_RUN = 1024  #: new pieces that go to the library as one text
MAGIC, END = b"S8TOKEN1", b"S8END..."


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, index of each block's first word (and of the end), and escapes (index, value) of unsigned 64-bit ids."""
    ids = np.asarray(ids)
    out = np.flatnonzero(ids.astype(U64) >> U64(60)) if ids.dtype.itemsize == 8 else np.zeros(0, np.int64)
    escapes = np.stack([out.astype(U64), ids[out].astype(U64)], axis=1) if len(out) else np.zeros((0, 2), U64)
    packed, sizes = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for low in range(0, len(ids), _AT_ONCE):
        words, per_block = _encode_blocks(ids[low : low + _AT_ONCE].astype(U64))
        packed.append(words)
        sizes.append(per_block)
    return np.concatenate(packed), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), escapes


def _encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all blocks, in order, and how many each block has."""
    ids[ids >> U64(60) > 0] = 0
    blocks = -(-len(ids) // BLOCK)
    size = np.full(blocks, BLOCK)
    size[-1] = len(ids) - BLOCK * (blocks - 1)
    padded = np.zeros(blocks * BLOCK + 240, U64)
    padded[: len(ids)] = ids
    bits = _WIDTHS[np.frexp(padded.astype(np.float64))[1]]
    at, place = np.arange(blocks), np.zeros(blocks, np.int64)
    pieces: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    while len(at):
        left, start = size[at] - place[at], at * BLOCK + place[at]
        select = np.full(len(at), len(SELECTORS) - 1)
        alive, most, seen = np.arange(len(at)), bits[start], 1
        for k in range(len(SELECTORS) - 2, -1, -1):  # more ids at fewer bits, as long as they fit
            count, width = SELECTORS[k]
            for j in range(seen, count):
                most = np.maximum(most, bits[start[alive] + j])
            seen = count
            ok = (most <= width) & (left[alive] >= count)
            alive, most = alive[ok], most[ok]
            if not len(alive):
                break
            select[alive] = k
        word = select.astype(U64) << U64(60)
        for k in np.flatnonzero(np.bincount(select, minlength=len(SELECTORS))):
            count, width = SELECTORS[k]
            if width:
                mine = np.flatnonzero(select == k)
                first = start[mine]
                total = padded[first]
                for j in range(1, count):
                    total |= padded[first + j] << U64(j * width)
                word[mine] |= total
        pieces.append(word)
        owners.append(at)
        place[at] += COUNTS[select]
        at = at[place[at] < size[at]]
    owner = np.concatenate(owners)
    return np.concatenate(pieces)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=blocks)


def decode(packed: np.ndarray, n_ids: int, escapes: np.ndarray) -> np.ndarray:
    """The ids of whole blocks; ``escapes`` has places from the first of these ids on."""
    select = (packed >> U64(60)).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(COUNTS[select])])[:-1]
    out = np.zeros(n_ids, U64)
    for k in np.unique(select):
        count, width = SELECTORS[k]
        if width:
            mine = np.flatnonzero(select == k)
            shifts = (np.arange(count) * width).astype(U64)
            out[start[mine, None] + np.arange(count)] = (packed[mine, None] >> shifts) & U64((1 << width) - 1)
    if len(escapes):
        out[escapes[:, 0].astype(np.int64)] = escapes[:, 1]
    return out


def shard_bytes(ids: np.ndarray, lengths: np.ndarray, keys: list[str | None]) -> bytes:
    packed, starts, escapes = encode(ids)
    names = json.dumps(keys, ensure_ascii=False, separators=(",", ":")).encode()
    footer = np.array([len(ids), len(starts) - 1, len(packed), len(escapes), len(lengths), len(names)], "<u8")
    body = b"".join([MAGIC, packed.astype("<u8").tobytes(), escapes.astype("<u8").tobytes(), starts[:-1].astype("<u8").tobytes(), lengths.astype("<u4").tobytes(), names, footer.tobytes()])
    return body + zlib.crc32(body).to_bytes(4, "little") + END


class Shard:
    """A shard file's directory, and its ids by document."""

    def __init__(self, body: bytes):
        if body[:8] != MAGIC or body[-8:] != END:
            raise ValueError("not a token shard")
        if zlib.crc32(body[:-12]) != int.from_bytes(body[-12:-8], "little"):
            raise ValueError("token shard is damaged")
        self.n_ids, blocks, n_words, n_escapes, n_docs, key_bytes = (int(x) for x in np.frombuffer(body[-60:-12], "<u8"))
        at = 8
        take = lambda n, kind: np.frombuffer(body, kind, n, at)
        self.packed = take(n_words, "<u8")
        at += 8 * n_words
        self.escapes = take(2 * n_escapes, "<u8").reshape(-1, 2)
        at += 16 * n_escapes
        self.starts = take(blocks, "<u8").astype(np.int64)
        at += 8 * blocks
        self.lengths = take(n_docs, "<u4").astype(np.int64)
        at += 4 * n_docs
        self.keys = json.loads(body[at : at + key_bytes])
        self.firsts = np.concatenate([[0], np.cumsum(self.lengths)])

    def ids(self, low: int, high: int) -> np.ndarray:
        """Ids low to high - 1 of the shard, decoding only the blocks that hold them."""
        a, b = low // BLOCK, -(-high // BLOCK)
        if a >= b:
            return np.zeros(0, U64)
        end = int(self.starts[b]) if b < len(self.starts) else len(self.packed)
        e = self.escapes[(self.escapes[:, 0] >= a * BLOCK) & (self.escapes[:, 0] < b * BLOCK)] if len(self.escapes) else self.escapes
        if len(e):
            e = np.stack([e[:, 0] - U64(a * BLOCK), e[:, 1]], axis=1)
        out = decode(self.packed[self.starts[a] : end].astype(U64), min(b * BLOCK, self.n_ids) - a * BLOCK, e)
        return out[low - a * BLOCK : high - a * BLOCK]


class Tokenizer:
    """A byte-level tokenizer file, with a bounded store of the ids of text pieces.

    Its pattern never joins a character with a space or newline that follows, so a text is cut before each
    of these that comes after something else than white space; the ids of the pieces make up the ids of the text.
    Pieces are told apart by a 64-bit hash, and by their bytes (up to 8) or a hash with another seed; each new one is
    encoded once. Where the hashes of different pieces meet, the batch goes to the library as it is.
    """

    def __init__(self, path: str, most: int = 1 << 20):
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        self.most = most
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        chars = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        known = {chr(c) for c in chars} | {chr(0x100 + k) for k in range(256 - len(chars))}  # the letters that stand for bytes
        self.length = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, k in vocabulary.items():
            self.length[k] = len(token) if set(token) <= known else len(token.encode())
        self.forget()

    def forget(self, needed: int = 0) -> None:
        """An empty store with room for ``most`` pieces, or as many as are needed now."""
        self.slots = np.full(1 << (4 * max(self.most, needed) - 1).bit_length(), -1, np.int32)  #: places in the arrays below, by key
        self.held, self.n_ids = 0, 0
        self.key, self.check = np.zeros(1, U64), np.zeros(1, U64)
        self.at, self.n = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.ids = np.zeros(1, np.uint32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The places of keys in the store, -1 for those that it does not have."""
        slot = (keys & U64(len(self.slots) - 1)).astype(np.int64)
        out = self.slots[slot]
        other = np.flatnonzero((out >= 0) & (self.key[out] != keys))
        while len(other):
            slot[other] = (slot[other] + 1) & (len(self.slots) - 1)
            out[other] = there = self.slots[slot[other]]
            other = other[(there >= 0) & (self.key[there] != keys[other])]
        return out

    def add(self, keys: np.ndarray, check: np.ndarray, at: np.ndarray, n: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Put distinct keys that the store does not have into it, with where their ids begin in ``ids``; their places."""
        place = np.arange(self.held, self.held + len(keys), dtype=np.int32)
        self.key, self.check = _put(self.key, self.held, keys), _put(self.check, self.held, check)
        self.at, self.n = _put(self.at, self.held, at + self.n_ids), _put(self.n, self.held, n)
        self.ids = _put(self.ids, self.n_ids, ids)
        self.held, self.n_ids = self.held + len(keys), self.n_ids + len(ids)
        slot = (keys & U64(len(self.slots) - 1)).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.slots[slot[todo]] < 0]
            self.slots[slot[free]] = place[free]  # of several that meet in a slot one stays
            todo = todo[self.slots[slot[todo]] != place[todo]]
            slot[todo] = (slot[todo] + 1) & (len(self.slots) - 1)
        return place

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last byte of the pieces; none spans two rows."""
        gap = (data == 0x20) | (data == 0x0A)
        # After another byte than ASCII white space or control characters, and than what ends a wide space
        solid = (data > 0x20) & (data < 0x7F)
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = gap[1:] & (solid | _ends_letter(data))[:-1]
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        start = np.flatnonzero(cut[: len(data)])
        return start, np.append(start[1:], len(data))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after the other, and how many each row has."""
        from .words import hashes

        data, offsets = raw(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(column), np.int64)
        start, end = self.pieces(data, offsets)
        key, check = hashes(data, start, end), _second(data, start, end)
        coded = pa.array(key).dictionary_encode()
        distinct, inverse = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        example = np.zeros(len(distinct), np.int64)
        example[inverse] = np.arange(len(key))
        if (check[example][inverse] != check).any():
            return self.plain(column)
        check = check[example]
        place = self.find(distinct)
        if ((place >= 0) & (self.check[place] != check)).any():
            return self.plain(column)
        new = np.flatnonzero(place < 0)
        if len(new):
            if self.held + len(new) > self.most:
                self.forget(len(distinct))
                new = np.arange(len(distinct))
            ids, at, n = self.fresh(data, start[example[new]], end[example[new]])
            place[new] = self.add(distinct[new], check[new], at, n, ids)
        at, n = self.at[place][inverse], self.n[place][inverse]
        ends = np.concatenate([[0], np.cumsum(n)])
        out = self.ids[np.repeat(at - ends[:-1], n) + np.arange(int(ends[-1]))]
        return out, np.diff(ends[np.searchsorted(start, offsets)])

    def plain(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`encode`, without the store."""
        got = [x.ids for x in self.library.encode_batch_fast([x or "" for x in column.to_pylist()], add_special_tokens=False)]
        return np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got], np.int64)

    def fresh(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces by the library, where each piece's begin, and how many it has.

        Pieces that begin with a gap are encoded in runs, which are cut where the bytes of the ids reach the
        pieces' ends; others, first of their text or with white space at their end, one by one.
        """
        gap = (data[start] == 0x20) | (data[start] == 0x0A)
        last = data[end - 1]
        gap &= (last > 0x20) & (last < 0x7F) | _ends_letter(data)[end - 1]
        at, n = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)]
        total = 0
        several, single = np.flatnonzero(gap), np.flatnonzero(~gap)
        for low in range(0, len(several), _RUN):
            mine = several[low : low + _RUN]
            sizes = end[mine] - start[mine]
            edges = np.cumsum(sizes)
            run = data[np.repeat(start[mine] - (edges - sizes), sizes) + np.arange(int(edges[-1]))].tobytes().decode()
            got = np.array(self.library.encode_batch_fast([run], add_special_tokens=False)[0].ids, np.uint32)
            reach = np.cumsum(self.length[got])
            cuts = np.searchsorted(reach, edges)
            if reach[-1] != edges[-1] or (reach[cuts] != edges).any():
                single = np.concatenate([single, mine])
                continue
            n[mine] = np.diff(cuts, prepend=-1)
            at[mine] = total + cuts + 1 - n[mine]
            out.append(got)
            total += len(got)
        for low in range(0, len(single), 4096):
            mine = single[low : low + 4096]
            got = [x.ids for x in self.library.encode_batch_fast([data[a:b].tobytes().decode() for a, b in zip(start[mine].tolist(), end[mine].tolist())], add_special_tokens=False)]
            n[mine] = [len(x) for x in got]
            at[mine] = total + np.cumsum(n[mine]) - n[mine]
            out.append(np.array([i for x in got for i in x], np.uint32))
            total += len(out[-1])
        return np.concatenate(out), at, n


def _ends_letter(data: np.ndarray) -> np.ndarray:
    """Whether a byte ends a two-byte letter U+00C0 to U+024F, which is never white space."""
    out = np.zeros(len(data), bool)
    if len(data) > 1:
        out[1:] = (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[:-1] >= 0xC3) & (data[:-1] <= 0xC8)
    return out


def _second(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A second number of each span, independent of its hash: its own bytes and length up to 8 bytes, else a hash with another seed."""
    from .words import hashes, mix

    length = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    blocks = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the 8 bytes from each place on
    masks = np.array([*((1 << 8 * n) - 1 for n in range(8)), (1 << 64) - 1], U64)
    few = np.minimum(length, 8)
    out = (blocks[start] & masks[few]) ^ mix(np.arange(9, dtype=U64))[few]
    long = np.flatnonzero(length > 8)
    out[long] = hashes(data, start[long], end[long], 1)
    return out


def _put(held: np.ndarray, n: int, more: np.ndarray) -> np.ndarray:
    """``held`` with ``more`` from place n on; where that is beyond its end, an array of twice the size or more."""
    if n + len(more) > len(held):
        held = np.concatenate([held[:n], np.zeros(max(len(held), n + len(more)), held.dtype)])
    held[n : n + len(more)] = more
    return held


@lru_cache(maxsize=1)
def tokenizer(path: str) -> Tokenizer:
    """The last tokenizer of this process. Its store, which is bounded, also serves later tasks of the same worker."""
    return Tokenizer(path)


ROWS = T.StructType([T.StructField("path", T.StringType()), T.StructField("part", T.LongType()), T.StructField("shard", T.LongType()), T.StructField("n_documents", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("bytes", T.LongType())])


def _write(folder: str, path: str, end_id: int, shard_ids: int):
    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_shared(folder)
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        shard = n = 0
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        keys: list[str | None] = []

        def flush() -> pa.RecordBatch:
            nonlocal shard, n
            counts = np.concatenate(lengths)
            body = shard_bytes(np.concatenate(ids), counts, keys)
            name = f"part-{part:06d}-{shard:06d}-{attempt}.s8"
            with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(body)
            row = pa.record_batch([pa.array([x]) for x in (f"{folder}/{name}", part, shard, len(keys), int(counts.sum()), len(body))], ROWS.names)
            shard, n = shard + 1, 0
            for x in (ids, lengths, keys):
                x.clear()
            return row

        for batch in batches:
            text, key = batch.column(1), batch.column(0)
            for low, high in slices(text, 1 << 20):
                got, counts = tokenizer(path).encode(text.slice(low, high - low))
                ends = np.cumsum(counts)
                ids.append(np.insert(got, ends, np.uint32(end_id)))
                lengths.append(counts + 1)
                keys += key.slice(low, high - low).to_pylist()
                n += len(ids[-1])
                if n >= shard_ids:
                    yield flush()
        if keys:
            yield flush()

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, shard_ids: int = 4 << 20, folder: str | None = None) -> DataFrame:
    """Write the ids of all texts in ascending order of id; a row for each shard: path, base (ids before it), n_ids, ...

    Null and empty texts have the end id only. Null ids come first; rows that repeat an id are all
    written, in the order of a hash of their texts, and an id that many rows have is shared among tasks. Ids of any
    type come back, empty strings and line ends included; other columns don't matter; an empty table makes no shards.
    A text may be longer than a shard. The number of shards follows the size of the data; their order
    and first ids are computed over the table of shards, which is the only table that is put in order in one task.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    fs, root = open_shared(folder)
    fs.create_dir(root, recursive=True)
    text = F.col(text_col).cast("string")
    # Rows that repeat an id are told apart by their texts, and equal ones by the input's partition
    rows = docs.select(F.col(id_col).alias("key"), F.xxhash64(text).alias("tie"), F.spark_partition_id().alias("from"), text.alias("text"))
    parts = max(rows.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, "key", "tie", "from").sortWithinPartitions("key", "tie", "from").select(F.col("key").cast("string").alias("key"), "text")
    shards = stored(dealt.mapInArrow(_write(folder, tokenizer_path, end_id, shard_ids), ROWS), "shards")
    order = W.orderBy("part", "shard").rowsBetween(W.unboundedPreceding, -1)
    return stored(shards.withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0))), "shards")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            fs, name = open_shared(path)
            with fs.open_input_file(name) as file:
                shard = Shard(file.read())
            low = 0
            while low < len(shard.keys):  # about a million ids at a time
                high = max(low + 1, int(np.searchsorted(shard.firsts, shard.firsts[low] + (1 << 20), side="right")) - 1)
                a, b = int(shard.firsts[low]), int(shard.firsts[high])
                ids = shard.ids(a, b).astype("<u4")
                cuts = (shard.firsts[low : high + 1] - a).tolist()
                crc = [zlib.crc32(ids[x:y]) for x, y in zip(cuts[:-1], cuts[1:])]
                yield pa.record_batch([pa.array(shard.keys[low:high], pa.string()), pa.array(shard.firsts[low:high] + base, pa.int64()), pa.array(shard.lengths[low:high], pa.int64()), pa.array(crc, pa.int64())], ["key", "start", "n_tokens", "ids_crc32"])
                low = high


def read_tokens(shards: DataFrame, id_type: T.DataType, *, id_col: str = "doc_id") -> DataFrame:
    """``<id>, start, n_tokens, ids_crc32`` of each document, from the shard files; a row for each row that was written."""
    parts = max(1, int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    read = shards.select("path", "base").repartition(parts).mapInArrow(_read, "key string, start long, n_tokens long, ids_crc32 long")
    return read.select(F.col("key").cast(id_type).alias(id_col), "start", "n_tokens", "ids_crc32")
