import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from parcelyard.llm.mixing import mix, mixed_documents, word_count

SCHEMA = "doc_id long, text string, source string, size string, copies int"


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def targets_by_hand(sizes, weights, share, most):
    """Deal out by weight; what is above its cap goes back, again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        level = rest / (sum(weight[s] for s in order if s not in full) or 1)
        over = {s for s in order if s not in full and level * weight[s] >= most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else level * weight[s] for s in order}
        full |= over


def check(spark, rows, **options):
    docs = rows_of(spark, rows)
    got = mix(docs, **options).collect()
    assert len(got) == len(rows)
    sizes, taken = collections.Counter(), collections.Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.copies
        assert 0 <= r.copies <= 2
    want = targets_by_hand(dict(sizes), (3, 1, 2), 1.5, 2) if rows else {}
    largest = max((r.size for r in got), default=0)
    for r in got:
        assert r.target == pytest.approx(want[r.source])
        assert abs(taken[r.source] - r.target) <= largest
    again = mix(docs.orderBy(F.desc("text")), **options).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    return got


def test_targets_and_words(spark):
    rows = [(i, " ".join(["w"] * (i * 7919 % 50 + 1)), [None, "b", "a", "é", "z"][i % 5 if i % 3 else 1]) for i in range(600)]
    check(spark, rows)
    got = check(spark, rows, weight=F.length("text").cast("double"))
    assert len({r.copies for r in got}) > 1


def test_nulls_ties_repeats_and_empty(spark):
    rows = [(1, None, "a"), (None, "x y", "a"), (2, "", None), (2, "", None), (3, "p q r", "b"), (3, "p q r", "b")]
    got = check(spark, rows)
    by = collections.defaultdict(set)
    for r in got:
        by[(r.doc_id, r.source, r.size)].add(r.copies)
    assert all(len(x) == 1 for x in by.values())
    assert check(spark, []) == []
    assert all(r.copies == 0 or r.size == 0 for r in check(spark, [(1, None, "a"), (2, " ", "b")]))


def test_mixed_documents_repeats_rows(spark):
    rows = [(i, "w " * (i % 9 + 1), "ab"[i % 2]) for i in range(80)]
    docs = rows_of(spark, rows)
    copies = {r.doc_id: r.copies for r in mix(docs).collect()}
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    assert collections.Counter(r.doc_id for r in out.collect()) == collections.Counter({k: v for k, v in copies.items() if v})


def copies_by_hand(rows, targets, most, seed):
    """Rates by giving back what is above ``most``, then all of a source in the order of rank until its words are reached."""
    out = collections.Counter()
    for source, target in targets.items():
        mine = [(key, size, weight) for key, of, size, weight in rows if of == source]
        full = set()
        while True:
            left = sum(s * w for _, s, w in mine if w not in full)
            rate = (target - sum(most * s for _, s, w in mine if w in full)) / left if left else 0.0
            over = {w for _, _, w in mine if w not in full and rate * w >= most}
            if not over:
                break
            full |= over
        ranked, words = [], target
        for key, size, weight in mine:
            expected = float(most) if weight in full else rate * weight
            out[key] = int(expected)
            words -= size * int(expected)
            part = expected - int(expected)
            if part > 0:
                u = (int(hashlib.md5(f"{key}:{seed}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                ranked.append(((u / (1 - u)) / (part / (1 - part)), key, size))
        taken = 0
        for _, key, size in sorted(ranked):
            taken += size
            out[key] += taken - size / 2 <= words
    return out


@pytest.mark.parametrize("seed", [17, 5])
def test_draws_are_those_of_a_plain_version(spark, seed):
    rows = [(i, " ".join(["w"] * (i * 7919 % 97 + 1)), ["a", "b", "c", "hot", "hot", "hot"][i * 31 % 6]) for i in range(3000)]
    weight = F.length(F.bin(word_count(F.col("text")))).cast("double") + 1
    got = mix(rows_of(spark, rows), weight=weight, seed=seed).collect()
    sizes = collections.Counter()
    for r in got:
        sizes[r.source] += r.size
    targets = targets_by_hand(dict(sizes), (3, 1, 2), 1.5, 2)
    want = copies_by_hand([(r.doc_id, r.source, r.size, r.size.bit_length() + 1.0) for r in got], targets, 2, seed)
    assert {r.doc_id: r.copies for r in got} == {r.doc_id: want[r.doc_id] for r in got}
    assert len(set(want.values())) == 3
