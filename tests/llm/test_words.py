"""Word hashes: equal words meet, others don't, words of a common structure included."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from parcelyard.llm import decontaminate, jaccard, lines, queries, simple8b
from parcelyard.llm.words import hashes, words


def thue_morse(n, a="a", b="b"):
    """Two words of n letters that every polynomial modulo 2**64 takes for one, from 1024 letters on."""
    return tuple("".join(x[bin(k).count("1") & 1] for k in range(n)) for x in ((a, b), (b, a)))


@pytest.mark.parametrize("n", [1, 7, 8, 9, 16, 64, 1000, 1024, 1025, 2048, 4096, 70_000])
def test_structured_words_are_told_apart(n):
    x, y = thue_morse(n)
    w = words(pa.array([f"{x} {y} {x}", f"{y.upper()}\t{x}"], pa.large_string()))
    assert w.hash[0] == w.hash[2] == w.hash[4] and w.hash[1] == w.hash[3] != w.hash[0]


def test_words_with_zero_bytes_and_of_all_lengths():
    some = sorted({"a" * n + end for n in range(40) for end in ("", "\0", "\0\0", "b", "é")} - {""})
    w = words(pa.array([" ".join(some)], pa.large_string()))
    assert len(w.hash) == len(some) == len(set(w.hash.tolist()))
    data = np.frombuffer(b"abcdefgh" * 4, np.uint8)
    assert len(set(hashes(data, np.array([0, 8, 0]), np.array([8, 16, 16])).tolist())) == 2
    assert hashes(data, np.array([0]), np.array([8])) != hashes(data, np.array([0]), np.array([8]), 1)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_operators_tell_structured_words_apart(spark):
    x, y = thue_morse(2048)
    rows = [(1, f"one two {x} three four"), (2, f"one two {y} three four"), (3, x), (4, y), (5, f"{x} k {x} l {y} m")]
    got = simple8b.read_tokens(simple8b.write_tokens(table(spark, rows), queries.tokenizer_path()), table(spark, []).schema["doc_id"].dataType).orderBy("start").collect()
    library = simple8b.tokenizer(queries.tokenizer_path()).library
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for _, t in rows]
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicate_classes(table(spark, rows), shingle=4, num=85).collect()} == {k: k for k, _ in rows}
    found = decontaminate.contamination(table(spark, rows), spark.createDataFrame([(7, x)], "item_id long, text string"))
    assert {r.doc_id: r.n_hit for r in found.collect()} == {1: 1, 2: 0, 3: 1, 4: 0, 5: 2}
    counts = lines.line_quality(table(spark, [(1, f"a {x} b a {y} b"), (2, f"a {x} b a {x} b"), (3, f"{x}\n{y}\n{x}")])).collect()
    assert {r.doc_id: (r.n_repeat_words, r.n_dup_lines) for r in counts} == {1: (0, 0), 2: (6, 0), 3: (0, 1)}


def test_meeting_hashes_do_not_change_ids(monkeypatch):
    """With a first hash of three bits, ids still come from the library."""
    import parcelyard.llm.words as W

    real = W.hashes
    monkeypatch.setattr(W, "hashes", lambda data, start, end, seed=0: real(data, start, end, seed) >> np.uint64(61 if seed == 0 else 0))
    tk = simple8b.Tokenizer(queries.tokenizer_path())
    for texts in (["one two three", None, "four five six seven eight nine ten"], ["eleven"], ["twelve", "thirteen fourteen"]):
        ids, n = tk.encode(pa.array(texts, pa.large_string()))
        want = [tk.library.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == [i for x in want for i in x] and n.tolist() == [len(x) for x in want]
