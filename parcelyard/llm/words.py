"""Words of Arrow string columns as NumPy arrays: boundaries and 64-bit hashes, no Python loop over words.

All functions work on the UTF-8 bytes. A word is hashed in blocks of 8 bytes: each block is added to the
state, which goes through a 64-bit mixing function before the next one; words of more than ``_LONG``
bytes are hashed by xxh3. Equal words have equal hashes in every process. No block can undo another as in
polynomials modulo 2**64, so words of a common structure meet no more often than random ones: two given
words about once in 2**64. Texts written to collide are not defended against here; where a meeting
would change what is written, as in token files, bytes are compared by a second hash with another seed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
_LONG = 1 << 10  #: longer words are hashed one by one


def _mask(separators) -> np.ndarray:
    out = np.ones(256, bool)
    out[list(separators)] = False
    return out


#: bytes of words, by kind: between white space; or letters, digits and all beyond ASCII
KINDS = {
    "space": _mask([0x20, *range(0x09, 0x0E)]),
    "alnum": _mask([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]),
}
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose low bits depend on all bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_ODD = U64(0x9E3779B97F4A7C15)


def give_back() -> None:
    """Return what is free in this process to the system: Python workers are kept for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim is not None:
        trim(0)


def thrifty(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``, with its memory given back after the last batch."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return within


@dataclass
class Words:
    """The words of some rows: of which row, from and to which byte of ``data``, and their hashes."""

    data: np.ndarray
    offsets: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """For each row, and one more, the index of its first word."""
        return np.searchsorted(self.row, np.arange(len(self.offsets)))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer row is a range of its own."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1)
        yield low, high
        low = high


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """The hash of each span of ``data``."""
    length = end - start
    out = mix((length.astype(U64) + U64(seed << 32 | 1)) * _ODD)
    long = length > _LONG
    for k in np.flatnonzero(long).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]].tobytes(), seed)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    blocks = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the 8 bytes from each place on
    open_ = np.flatnonzero(~long & (length > 0))
    at = 0
    while len(open_):
        left = length[open_] - at
        block = blocks[start[open_] + at]
        last = left < 8
        block[last] &= (U64(1) << (left[last].astype(U64) * U64(8))) - U64(1)
        out[open_] = mix(out[open_] * _ODD + block)
        open_, at = open_[left > 8], at + 8
    return out


def words(column: pa.Array, kind: str = "space", lower: bool = True, hashed: bool = True) -> Words:
    """The words of a string column."""
    data, offsets = raw(column)
    if lower:
        data = LOWER[data]
    inside = KINDS[kind][data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[edges] = inside[edges]
    lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    end[lasts] = inside[lasts]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    row = np.searchsorted(offsets, s, side="right") - 1
    return Words(data, offsets, row, s, e, hashes(data, s, e) if hashed else np.zeros(0, U64))


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every n words in a row; of fewer words, but not none, all of them count as one."""
    first = w.first
    total = len(w.hash)
    row, out = np.zeros(0, np.int64), np.zeros(0, U64)
    if total >= n:
        inside = np.flatnonzero(w.row[: total - n + 1] == w.row[n - 1 :])
        out = np.full(len(inside), 0x243F6A8885A308D3, U64)
        for k in range(n):
            out = mix(out * U64(0x9E3779B97F4A7C15) + w.hash[inside + k])
        row = w.row[inside]
    lengths = np.diff(first)
    few = np.flatnonzero((lengths > 0) & (lengths < n))
    if len(few):
        short = np.full(len(few), 0x452821E638D01377, U64)
        for k in range(n - 1):
            there = lengths[few] > k
            short[there] = mix(short[there] * U64(0x9E3779B97F4A7C15) + w.hash[first[few[there]] + k])
        row, out = np.concatenate([row, few]), np.concatenate([out, short])
        order = np.argsort(row, kind="stable")
        row, out = row[order], out[order]
    return row, out


def gram_sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds by row, and the distinct gram hashes of each row in ascending order."""
    row, out = grams(w, n)
    bounds = np.searchsorted(row, np.arange(len(w.offsets)))
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        out[low:high].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    row, out = row[keep], out[keep]
    return np.searchsorted(row, np.arange(len(w.offsets))), out
