"""The label model on made votes, the sample that models are fitted on, and held-out grades and tails."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelyard.llm import queries, toxicity
from parcelyard.llm.features import training_rows

HITS = np.array([0.3, 0.35, 0.4, 0.25, 0.3, 0.3])
FALSE = np.array([0.01, 0.02, 0.01, 0.005, 0.01, 0.01])


def made_votes(n, seed, twins=0):
    """Truth, and votes of six voters with known accuracies; twins vote as the first does, but for one in fifty."""
    r = np.random.default_rng(seed)
    y = r.random(n) < 0.15
    votes = (r.random((n, 6)) < np.where(y[:, None], HITS, FALSE)).astype(np.float32)
    if twins:
        copies = np.repeat(votes[:, :1], twins, axis=1)
        votes = np.concatenate([votes, np.where(r.random(copies.shape) < 0.02, 1 - copies, copies)], axis=1).astype(np.float32)
    return y, votes


@pytest.mark.parametrize("labelled", [0, 400])
def test_accuracies_are_recovered_without_many_labels(labelled):
    y, votes = made_votes(8000, 1)
    label = np.where(np.arange(len(y)) < labelled, y, np.nan).astype(float)
    model = toxicity.fit_labels(votes, label)
    assert np.abs(model.fires[1] - HITS).max() < 0.08 and np.abs(model.fires[0] - FALSE).max() < 0.02
    assert abs(model.prior - 0.15) < 0.05 and (model.edges == [] or not labelled)


@pytest.mark.parametrize("seed", [2, 3, 4])
def test_correlated_voters_count_once(seed, monkeypatch):
    y, votes = made_votes(8000, seed, twins=4)
    label = np.where(np.arange(len(y)) < 3000, y, np.nan).astype(float)
    model = toxicity.fit_labels(votes, label)
    assert {(0, 6), (0, 7), (0, 8), (0, 9)} <= {tuple(sorted(e)) for e in model.edges} and len(model.edges) <= 6
    assert np.abs(model.fires[1][:6] - HITS).max() < 0.08 and abs(model.prior - 0.15) < 0.03
    monkeypatch.setattr(toxicity, "_forest", lambda votes, q: np.full(votes.shape[1], -1))
    alone = toxicity.fit_labels(votes, label)
    twins_only = np.zeros((1, 10), np.float32)
    twins_only[0, [0, 6, 7, 8, 9]] = 1
    # In truth five that copy each other are worth about one, which leaves the row in doubt
    assert model.posterior(twins_only)[0] < 0.85 and alone.posterior(twins_only)[0] > 0.99
    error = lambda m: np.mean((m.posterior(votes) - y) ** 2)
    assert error(model) < 0.05 < 2 * error(model) < error(alone)


def test_model_of_no_rows():
    model = toxicity.fit_labels(np.zeros((0, 3), np.float32), np.zeros(0))
    assert model.edges == [] and model.posterior(np.zeros((2, 3), np.float32)).tolist() == pytest.approx([model.posterior(np.zeros((1, 3)))[0]] * 2)


def test_sample_has_one_row_an_id_and_bounded_bytes(spark):
    docs = spark.createDataFrame([(k, "t" * 100) for k in range(90)] * 5 + [(5, None), (None, "x"), (200, "u" * 5000)] + [(300 + k, "v" * 50) for k in range(60)], "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(k, k % 2) for k in [*range(90), 200]] * 2 + [(None, 1), (7, None)], "doc_id long, toxic int")
    found = training_rows(docs, labels, ["toxic"], id_col="doc_id", text_col="text", most=1000, unlabelled=1000, most_bytes=4000).to_pandas()
    assert found.key.is_unique and found.text.str.len().sum() <= 4000 and 200 not in set(found.key)
    again = training_rows(docs.orderBy(F.desc("text")), labels, ["toxic"], id_col="doc_id", text_col="text", most=1000, unlabelled=1000, most_bytes=4000).to_pandas()
    assert found.equals(again)
    found = training_rows(docs, labels, ["toxic"], id_col="doc_id", text_col="text", most=10, unlabelled=25).to_pandas()
    assert found.toxic.notna().sum() == 10 and 0 < found.toxic.isna().sum() <= 25
    held = {r.k for r in docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 == 1).select(F.col("doc_id").alias("k")).collect()}
    assert not held & set(found.key)


def test_held_out_grades_and_tails(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    graded = queries.op3_ordinal_quality(spark, d).where("held_out").join(labels, "doc_id").toPandas()
    bad, good = graded[graded.quality == 0], graded[graded.quality == 1]
    assert (~bad.kept).mean() > 0.9 and good.kept.mean() > 0.99
    clean, toxic = good[good.toxic == 0], good[good.toxic == 1]
    assert bad.expected_grade.mean() < 0.3 < 1 < toxic.expected_grade.mean() < clean.expected_grade.mean()
    # Tails are probabilities: their mean is the share of good ones, and where they are low few are good
    assert abs(graded.tail_prob.mean() - (graded.quality == 1).mean()) < 0.02
    low, high = graded[graded.tail_prob < 0.2], graded[graded.tail_prob > 0.8]
    assert (low.quality == 1).mean() < 0.1 and (high.quality == 1).mean() > 0.98
