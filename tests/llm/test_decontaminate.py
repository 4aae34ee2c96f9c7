import hashlib
import re

from pyspark.sql import functions as F

from parcelyard.llm.decontaminate import contamination, decontaminated

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_hand(docs, items, window=10):
    out = []
    for i, text in docs:
        w = words(text)
        hit, names = set(), set()
        for name, item in items:
            v = words(item)
            n = min(window, len(v))
            for p in range(len(v) - n + 1 if v else 0):
                for q in range(len(w) - n + 1):
                    if w[q : q + n] == v[p : p + n]:
                        hit |= set(range(q, q + n))
                        names.add("null" if name is None else str(name))
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(*x, 1, "y") for x in docs], "doc_id long, text string, n_words int, matches string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(d, b, **options)
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got.collect()), key=str), d, b, got


ALPHABET = [f"w{k}" for k in range(30)]


def seq(start, n):
    return [ALPHABET[(start * 7 + k * k) % 30] for k in range(start, start + n)]


ITEMS = [(1, " ".join(seq(0, 40))), (2, "Short item"), (None, " ".join(seq(5, 12))), (10, None), (11, ""), (2, " ".join(seq(3, 10))), (12, "one")]
DOCS = [
    (0, "x " * 30 + " ".join(seq(0, 40)[2:27]) + " y"), (1, None), (2, ""), (3, "a SHORT, item! short item short"), (4, " ".join(seq(0, 9))),
    (5, " ".join(seq(0, 40) * 3)), (5, " ".join(seq(0, 40) * 3)), (None, "ONE"), (7, " ".join(["clean"] * 400)), (8, " ".join(seq(0, 10) + ["z"] + seq(10, 10) + seq(3, 10))),
]


def test_against_brute_force(spark):
    got, *_ = run(spark, DOCS, ITEMS)
    assert got == by_hand(DOCS, ITEMS)


def test_blocks_and_small_shards_change_nothing(spark):
    got, *_ = run(spark, DOCS, ITEMS, block_bytes=60, shard_bytes=50)
    assert got == by_hand(DOCS, ITEMS)


def test_longest_matches_and_removal(spark):
    _, d, b, got = run(spark, DOCS, ITEMS)
    match = {r.doc_id: r.matches for r in got.collect()}
    best = max(match[0], key=lambda m: m.n_words)
    assert (best.item_id, best.doc_word, best.item_word, best.n_words) == ("1", 30, 2, 25)
    left = decontaminated(d, b)
    assert left.columns == d.columns
    assert {r.doc_id for r in left.collect()} == {x[0] for x in by_hand(DOCS, ITEMS) if x[2] == 0}


def longest_by_hand(text, items, window=10):
    """At each place the longest match of at least a window, if it doesn't lie in one that begins before it."""
    out, reach, w = [], 0, words(text)
    for q in range(len(w)):
        best = None
        for name, item in items:
            v = words(item)
            for p in range(len(v)):
                n = 0
                while p + n < len(v) and q + n < len(w) and v[p + n] == w[q + n]:
                    n += 1
                if n >= window or n == len(v):
                    best = min(best or (0,), (-n, "null" if name is None else str(name), p))
        if best and q - best[0] > reach:
            out.append((best[1], q, best[2], -best[0]))
            reach = q - best[0]
    return out


def test_longest_matches_at_all_places(spark):
    docs = [*DOCS, (9, " ".join([*seq(0, 40)[:15], "z", *seq(0, 40)[20:36], "z", *seq(0, 40)[:12]])), (13, "e " * 70 + "f " + "e " * 12), (14, " ".join(seq(5, 30)))]
    items = [*ITEMS, (20, "e " * 40), (21, "e " * 25 + "f"), (3, " ".join(seq(0, 40)))]
    for options in ({}, {"block_bytes": 60, "shard_bytes": 50}, {"block_bytes": 300}):
        *_, got = run(spark, docs, items, **options)
        rows = [(r.doc_id, sorted(map(tuple, r.matches), key=lambda m: m[1])) for r in got.collect()]
        assert sorted(rows, key=str) == sorted(((i, longest_by_hand(x, items)) for i, x in docs), key=str)
    got, *_ = run(spark, docs, items)
    assert got == by_hand(docs, items)


def test_repetitive_texts_make_no_pairs():
    import tracemalloc

    import pyarrow as pa

    from parcelyard.llm import decontaminate
    from parcelyard.llm.words import words as words_of

    block = decontaminate.block_of(["a"], ["e " * 2000], 10)
    w = words_of(pa.array(["f " + "e " * 40_000, "e " * 9, "g " + "e " * 12 + "g"], pa.large_string()), "alnum")
    tracemalloc.start()
    found = decontaminate.search(block, w)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20
    assert found.spans == {0: [(1, 40_001)], 2: [(1, 13)]} and found.items == {0: ["a"], 2: ["a"]}
    ends = [m[1] + m[3] for m in found.matches[0]]
    assert found.matches[0][0] == ("a", 1, 0, 2000) and max(ends) == 40_001 and found.matches[2] == [("a", 1, 0, 12)]


def test_blocks_are_dealt_by_size(spark):
    from parcelyard.llm import decontaminate

    items = spark.createDataFrame([(str(k % 50), "word " * (k % 50)) for k in range(400)], "name string, text string")
    dealt, blocks = decontaminate.dealt(items, 1000)
    sizes = {r.deal: r.n for r in dealt.groupBy("deal").agg(F.sum(F.octet_length("text") + F.octet_length("name")).alias("n")).collect()}
    assert dealt.count() == 50 and sorted(d for b in blocks for d in b) == sorted(sizes)
    assert all(sum(sizes[d] for d in b) <= 1000 or len(b) == 1 for b in blocks) and len(blocks) > 5


def test_empty_tables(spark):
    assert run(spark, [], ITEMS)[0] == []
    assert all(x[2] == 0 for x in run(spark, DOCS, [])[0])
