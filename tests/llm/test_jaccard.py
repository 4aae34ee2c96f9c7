"""The order, the suffix filter's bound, and how many pairs frequent n-grams make."""

import numpy as np
import pytest

from parcelyard.llm import jaccard
from parcelyard.llm.words import U64


def made_order(r, listed=0):
    grams = r.integers(0, 2**64, 4000, dtype=np.uint64)
    counts = np.bincount((grams >> U64(58)).astype(np.int64), minlength=64).astype(np.uint32) ** r.integers(1, 4, 64).astype(np.uint32)
    some = grams[:listed]
    return grams, jaccard.Order(counts, some, r.integers(1, 5000, listed))


@pytest.mark.parametrize("listed", [0, 500])
def test_cells_follow_the_order(listed):
    grams, order = made_order(np.random.default_rng(1), listed)
    rank, cell = order.of(grams)
    turn = np.lexsort((grams, rank))
    assert (np.diff(cell[turn]) >= 0).all() and cell.min() >= 0 and cell.max() < jaccard.CELLS and len(set(cell.tolist())) > 8
    if listed:
        assert rank[listed:].max() < 256 <= rank[:listed].min()


@pytest.mark.parametrize("seed", range(6))
def test_the_bound_never_loses_an_overlap(seed):
    r = np.random.default_rng(seed)
    grams, order = made_order(r, 200 if seed % 2 else 0)
    tight = 0
    for _ in range(300):
        n = int(r.integers(1, 400))
        base = r.choice(grams, n, replace=False)
        sets = []
        for _ in range(2):
            mine = np.concatenate([base[r.random(n) < r.choice([0.1, 0.5, 0.95, 1])], r.choice(grams, int(r.integers(0, 60)), replace=False)])
            mine = np.unique(mine)
            rank, cell = order.of(mine)
            sets.append((mine[np.lexsort((mine, rank))], np.bincount(cell, minlength=jaccard.CELLS)))
        (x, cx), (y, cy) = sets
        both = np.intersect1d(x, y)
        for g in both[:5]:
            at = [np.array([int(np.flatnonzero(s == g)[0])]) for s in (x, y)]
            bound = int(jaccard.overlap_bound(cx[None], cy[None], *at)[0])
            assert bound >= len(both)
            tight += bound < min(len(x), len(y))
    assert tight > 300


def test_full_cells_tell_nothing():
    x = np.zeros((1, jaccard.CELLS), np.int64)
    x[0, 3] = 65535
    assert jaccard.overlap_bound(x, x, np.array([0]), np.array([0]))[0] > 10**12


def common_passages(n):
    """Documents that aren't alike; each passage of 8 words is in one in twenty of them, at the start, and short texts hold little else."""
    return [(k, f"p{k % 20}a p{k % 20}b p{k % 20}c p{k % 20}d p{k % 20}e p{k % 20}f p{k % 20}g p{k % 20}h " + " ".join(f"u{k}x{j}" for j in range(14 + k % 9))) for k in range(n)]


@pytest.mark.parametrize("bits", [jaccard.SKETCH_BITS, 3])
def test_frequent_grams_make_few_pairs(spark, bits, monkeypatch):
    """With 8 counters all n-grams look alike, and only the exact counts keep the passages out of the prefixes."""
    monkeypatch.setattr(jaccard, "PAIRS_EACH", 8)
    rows = common_passages(800) + [(1000 + k, rows_text) for k, (_, rows_text) in enumerate(common_passages(40))] + [(2000 + k, t + " end") for k, t in common_passages(30)]
    table = spark.createDataFrame(rows, "id long, text string").repartition(4)
    join = jaccard._Join(table, 4, 85, 100, bits)
    join.stars()
    while join.list_frequent():
        join.sign()
        join.stars(1)
    join.rest()
    linked = {frozenset(x) for x in join.edges.collect()}
    assert len(linked) == 30
    assert join.n_pairs < 4 * len(rows), join.n_pairs
    assert bool(join.listed) == (bits == 3)
    join.drop()


def test_long_texts_are_verified_in_bounded_pieces(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "VERIFY_BYTES", 5000)
    base = [f"w{k}" for k in range(3000)]
    rows = [(k, " ".join(base[:2990] + [f"x{k}"] * 3 + base[2993:])) for k in range(12)]
    got = jaccard.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4, num=85).collect()
    assert {r.component_id for r in got} == {0}
