"""Toxicity by weak supervision.

Many voters say whether a text looks toxic: one for each word of a lexicon, one for each word that the labelled
rows single out, and patterns. A generative model of the votes is fitted by expectation maximisation on a sample of
documents outside of the held-out fold, most of them without labels: the share of toxic texts, each voter's accuracy
(how often it fires on toxic and on other texts), and correlations. A label, where a row has one, is one more voter whose
errors are estimated too.

Correlations are estimated for pairs: given the posterior labels, the conditional mutual information of every two
voters is taken, and the strongest pairs that make no circle become the edges of a forest. A voter with a parent has
its accuracies for either vote of the parent, so that what two voters say together counts as much as it is worth.
Pairs that such a forest leaves out are taken as independent given the others.

A linear classifier over the votes and hashed words is then trained on the posterior labels, and scores all texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import N_FEATURES, Sparse, adam, features, held_out, sigmoid, stacked, training_rows
from .words import U64, Words, gram_sets, raw, slices, thrifty, words

#: common insults in four languages, in lower case
LEXICON = (
    "asshole", "bastard", "bitch", "clown", "coward", "cretin", "degenerate", "disgusting", "dumb", "filthy", "fool", "freak", "garbage", "idiot", "idiots", "idiotic", "imbecile", "jerk", "liar", "loser", "losers",
    "lowlife", "moron", "morons", "moronic", "parasite", "pathetic", "pig", "retard", "scum", "scumbag", "shithead", "stupid", "trash", "ugly", "useless", "vermin", "vile", "worthless",
    "abruti", "connard", "crétin", "débile", "idiote", "imbécile", "ordure", "pourriture", "salaud",
    "abschaum", "arschloch", "dummkopf", "idiotin", "miststück", "schwachkopf", "trottel", "versager", "wertlos",
    "basura", "cabrón", "escoria", "estúpido", "estúpida", "gilipollas", "idiota", "imbécil", "inútil", "patético",
)
PATTERNS = ("two_insults", "three_insults", "dense_insults", "insult_after_article", "insult_after_you", "shouting", "many_exclamations")
_ARTICLES = ("the", "a", "an", "you", "le", "la", "un", "une", "der", "die", "ein", "eine", "el", "los")
_YOU = ("you", "your", "you're", "ur", "tu", "toi", "vous", "du", "dich", "ihr", "eres", "vosotros")
LEARNED = 256  #: words taken from the labelled rows, at most: those that chance explains least


def _hash(some: tuple[str, ...]) -> np.ndarray:
    return words(pa.array(some, pa.large_string()), "alnum").hash if some else np.zeros(0, U64)


@dataclass
class Voters:
    """The lexicon, and words learned from labelled rows, by hash."""

    names: list[str]
    hashes: np.ndarray

    @staticmethod
    def of(learned: tuple[str, ...] = ()) -> Voters:
        names = list(dict.fromkeys([*LEXICON, *learned]))
        return Voters(names, _hash(tuple(names)))

    def __len__(self) -> int:
        return len(self.names) + len(PATTERNS)

    def votes(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, Words]:
        """Row and voter of the votes, without repeats."""
        w = words(column, "alnum")
        rows = len(column)
        order = np.argsort(self.hashes)
        spot = np.minimum(np.searchsorted(self.hashes[order], w.hash), len(order) - 1)
        hit = np.flatnonzero(self.hashes[order][spot] == w.hash)
        voter, row = order[spot[hit]], w.row[hit]
        n = np.bincount(row, minlength=rows)
        size = np.bincount(w.row, minlength=rows)
        follows = np.zeros(len(hit), np.uint64)
        inside = (hit > 0) & (w.row[np.maximum(hit - 1, 0)] == row)
        follows[inside] = w.hash[hit[inside] - 1]
        after = lambda some: np.bincount(row[np.isin(follows, _hash(some))], minlength=rows) > 0
        data, offsets = raw(column)
        upper = np.diff(np.concatenate([[0], np.cumsum((data >= 0x41) & (data <= 0x5A))])[offsets])
        lower = np.diff(np.concatenate([[0], np.cumsum((data >= 0x61) & (data <= 0x7A))])[offsets])
        marks = np.diff(np.concatenate([[0], np.cumsum(data == 0x21)])[offsets])
        pattern = [n >= 2, n >= 3, n > 0.02 * np.maximum(size, 50), after(_ARTICLES), after(_YOU), upper > 2 * lower + 20, marks > 0.3 * np.maximum(size, 20)]
        rows_of, voters_of = [row], [voter]
        for k, fired in enumerate(pattern):
            at = np.flatnonzero(fired)
            rows_of.append(at)
            voters_of.append(np.full(len(at), len(self.names) + k))
        key = np.unique(np.concatenate(rows_of) * (len(self) + 1) + np.concatenate(voters_of))
        return key // (len(self) + 1), key % (len(self) + 1), w


def learned_words(texts: pa.Array, label: np.ndarray, *, least: int = 5, odds: float = 20.0, chance: float = 1e-6) -> tuple[str, ...]:
    """Words of toxic rows: ``odds`` times likelier there, and in more of them than chance allows.

    Near copies, which share the smallest hash of their 3-word shingles, count once.
    """
    toxic = label >= 0.5
    seen: set[int] = set()
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    n = [0, 0]
    for low, high in slices(texts):
        part = texts.slice(low, high - low)
        w = words(part, "alnum")
        first = w.first.tolist()
        bounds, grams = gram_sets(w, 3)
        text = w.data.tobytes()
        for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            if a == b or int(grams[a]) in seen:
                continue
            seen.add(int(grams[a]))
            y = int(toxic[low + k])
            n[y] += 1
            counts[y].update({text[s:e] for s, e in zip(w.start[first[k] : first[k + 1]].tolist(), w.end[first[k] : first[k + 1]].tolist())})
    base = n[1] / max(1, sum(n))
    good = []
    for word, c in counts[1].items():
        other = counts[0][word]
        ratio = (c + 0.5) / (n[1] + 1) / ((other + 0.5) / (n[0] + 1))
        if c < least or ratio < odds:
            continue
        total = c + other
        tail = sum(math.exp(math.lgamma(total + 1) - math.lgamma(j + 1) - math.lgamma(total - j + 1) + j * math.log(base) + (total - j) * math.log1p(-base)) for j in range(c, total + 1)) if 0 < base < 1 else 1.0
        if tail < chance:
            good.append((tail, word.decode()))
    return tuple(w for _, w in sorted(good)[:LEARNED])


@dataclass
class LabelModel:
    """Share of toxic rows; how often each voter fires on other and on toxic rows, overall and by its parent's vote."""

    prior: float
    fires: np.ndarray  #: (2, voters): on other, on toxic rows
    label: np.ndarray  #: how often the label says toxic, on other and on toxic rows
    parent: np.ndarray  #: of each voter, or -1
    by_parent: np.ndarray  #: (2 kinds of row, 2 votes of the parent, voters)

    @property
    def edges(self) -> list[tuple[int, int]]:
        """The pairs of correlated voters."""
        return [(int(p), k) for k, p in enumerate(self.parent) if p >= 0]

    def posterior(self, votes: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
        """How likely each row is toxic by its votes, and its label where that is known (not nan)."""
        fires, silent = np.log(self.by_parent[1] / self.by_parent[0]), np.log((1 - self.by_parent[1]) / (1 - self.by_parent[0]))
        z = math.log(self.prior / (1 - self.prior)) + silent[0].sum() + votes @ (fires[0] - silent[0])
        some = np.flatnonzero(self.parent >= 0)
        above, below = votes[:, self.parent[some]], votes[:, some]  # what a parent that fires changes
        z = z + above @ (silent[1] - silent[0])[some] + (above * below) @ (fires[1] - silent[1] - fires[0] + silent[0])[some]
        if label is not None:
            a, b = self.label
            z = z + np.where(np.isnan(label), 0.0, np.where(label >= 0.5, math.log(b / a), math.log((1 - b) / (1 - a))))
        return sigmoid(z)

    def worth(self) -> np.ndarray:
        """The weight of each voter in a sum of votes: what its vote adds, given how its parent votes when it fires."""
        odds = np.log(self.by_parent[1] / self.by_parent[0]) - np.log((1 - self.by_parent[1]) / (1 - self.by_parent[0]))
        out = odds[0].copy()
        for p, k in self.edges:
            both = self.fires[1, p] * self.by_parent[1, 1, k] / max(self.fires[1, k], 1e-9)  # on toxic rows
            out[k] = (1 - min(both, 1.0)) * odds[0, k] + min(both, 1.0) * odds[1, k]
        return np.maximum(out, 0)


def _forest(votes: np.ndarray, q: np.ndarray, least: float = 15.0, seen: int = 5) -> np.ndarray:
    """The parent of each voter: a forest of the pairs with most conditional mutual information given the posteriors ``q``.

    Twice the information of a pair times the rows must be over ``least`` (independent voters stay under it but for one
    pair in some thousands), and both must have fired ``seen`` times, as nothing can be told of rarer ones.
    """
    n, v = votes.shape
    info = np.zeros((v, v))
    for weight in (q, 1 - q):
        total = weight.sum() + 1e-9
        weighted = votes * weight[:, None]
        both = votes.T @ weighted / total
        one = weighted.sum(axis=0) / total
        for x, y, joint in ((one, one, both), (one, 1 - one, one[:, None] - both), (1 - one, one, one[None, :] - both), (1 - one, 1 - one, 1 - one[:, None] - one[None, :] + both)):
            joint, alone = np.maximum(joint, 0), np.maximum(np.outer(x, y), 1e-12)
            info += total * np.where(joint > 1e-12, joint * np.log(np.maximum(joint, 1e-12) / alone), 0)
    count = votes.sum(axis=0)
    left, right = np.nonzero(np.triu((2 * info > least) & (count[:, None] >= seen) & (count[None, :] >= seen), 1))
    group = list(range(v))

    def top(k: int) -> int:
        while group[k] != k:
            group[k] = group[group[k]]
            k = group[k]
        return k

    near: list[list[int]] = [[] for _ in range(v)]
    for k in np.argsort(-info[left, right], kind="stable").tolist():
        a, b = int(left[k]), int(right[k])
        if top(a) != top(b):
            group[top(a)] = top(b)
            near[a].append(b)
            near[b].append(a)
    parent = np.full(v, -1)
    reached = np.zeros(v, bool)
    for root in np.argsort(-count, kind="stable").tolist():
        todo = [root] if not reached[root] else []
        while todo:
            k = todo.pop()
            reached[k] = True
            for j in near[k]:
                if not reached[j]:
                    parent[j] = k
                    todo.append(j)
    return parent


def fit_labels(votes: np.ndarray, label: np.ndarray, rounds: int = 30) -> LabelModel:
    """Expectation maximisation with a forest of correlated pairs, which is then estimated again. ``label`` is nan where unknown.

    The first forest is that of the votes as the labelled rows alone explain them. Independent voters are not fitted
    before, as many that copy each other would then be taken for the truth.
    """
    n, v = votes.shape
    bound = lambda x: np.clip(x, 1e-4, 1 - 1e-4)
    known = ~np.isnan(label)
    says = np.where(known, label, 0.0)
    # Beta priors: a voter fires on 0.2 % of other rows and 2 % of toxic ones, worth ten rows; of the label, 2 % is wrong
    start = np.array([np.full(v, 0.002), np.full(v, 0.02)])
    first = bound(np.array([(w @ votes[known] + 10 * s) / (w.sum() + 10) for w, s in zip((1 - says[known], says[known]), start)]))
    first[1] = np.maximum(first[1], first[0])
    model = LabelModel(0.1, first, np.array([0.02, 0.95]), np.full(v, -1), np.stack([first, first], axis=1))
    for _ in range(2 if n else 0):
        parent = _forest(votes, model.posterior(votes, label))
        # A voter with a parent starts as one that follows it in toxic and other rows alike
        some, by_parent = np.flatnonzero(parent >= 0), np.stack([model.fires, model.fires], axis=1)
        for vote in (0, 1):
            where = votes[:, parent[some]] == vote
            by_parent[:, vote, some] = bound(((where * votes[:, some]).sum(axis=0) + 10 * model.fires[:, some]) / (where.sum(axis=0) + 10))
        model = LabelModel(model.prior, model.fires, model.label, parent, by_parent)
        for _ in range(rounds):
            q = model.posterior(votes, label)
            sides = (1 - q, q)
            f = [(w @ votes + 10 * s) / (w.sum() + 10) for w, s in zip(sides, start)]
            f[1] = np.maximum(f[1], f[0])  # no voter speaks for a clean text
            fires = bound(np.array(f))
            by_parent = np.stack([fires, fires], axis=1)
            if len(some):
                above, below = votes[:, parent[some]], votes[:, some]
                for y, w in enumerate(sides):
                    for vote, where in enumerate((1 - above, above)):
                        weight = where * w[:, None]
                        # As if a voter had been seen ten times more with each vote of its parent, firing as often as it does
                        by_parent[y, vote, some] = bound(((weight * below).sum(axis=0) + 10 * fires[y, some]) / (weight.sum(axis=0) + 10))
                # A vote for toxic may be worth nothing beside its parent's, but no vote speaks for a clean text
                by_parent[1] = np.maximum(by_parent[1], by_parent[0])
            b = ((q * says)[known].sum() + 95) / (q[known].sum() + 100)
            a = (((1 - q) * says)[known].sum() + 2) / ((1 - q)[known].sum() + 100)
            model = LabelModel(float(bound((q.sum() + 10) / (n + 100))), fires, bound(np.array([a, max(b, a + 0.05)])), parent, by_parent)
    return model


@dataclass
class Classifier:
    voters: Voters
    weights: np.ndarray  #: of hashed features, then of voters
    model: LabelModel

    def score(self, column: pa.Array) -> np.ndarray:
        row, voter, _ = self.voters.votes(column)
        x, _ = features(column)
        z = x.dot(self.weights[:N_FEATURES]) + np.bincount(row, self.weights[N_FEATURES + voter], len(column))
        return sigmoid(z)


def train(texts: pa.Array, label: np.ndarray, *, steps: int = 120, rate: float = 0.1, decay: float = 2e-3) -> Classifier:
    """The classifier of some texts with labels of 0, 1, or nan for none."""
    known = np.flatnonzero(~np.isnan(label))
    voters = Voters.of(learned_words(texts.take(pa.array(known)), label[known]) if len(known) else ())
    parts, rows, who = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in slices(texts):
        part = texts.slice(a, b - a)
        parts.append(features(part)[0])
        r, k, _ = voters.votes(part)
        rows.append(r + a)
        who.append(k)
    row, voter = np.concatenate(rows), np.concatenate(who)
    votes = np.zeros((len(label), len(voters)), np.float32)
    votes[row, voter] = 1
    model = fit_labels(votes, label)
    # Voters start at what the label model finds them worth; the constant stands for silence of all
    start = np.zeros(N_FEATURES + len(voters))
    start[N_FEATURES:] = model.worth()
    start[N_FEATURES - 1] = math.log(model.prior / (1 - model.prior)) + np.log((1 - model.by_parent[1, 0]) / (1 - model.by_parent[0, 0])).sum()
    if not len(label):
        return Classifier(voters, start, model)
    target = model.posterior(votes)  # of the votes alone: labels only shaped the model
    x = stacked(parts)
    parts.clear()
    both = Sparse(x.n_rows, np.concatenate([x.row, row.astype(np.int32)]), np.concatenate([x.feature, (N_FEATURES + voter).astype(np.int32)]), np.concatenate([x.value, np.ones(len(row), np.float32)]))
    pull = np.full(len(start), decay)
    pull[N_FEATURES - 1 :] = 1e-4

    def gradient(w: np.ndarray) -> np.ndarray:
        return both.back((sigmoid(both.dot(w)) - target) / len(target), len(w)) + pull * (w - start)

    return Classifier(voters, adam(gradient, start, steps, rate), model)


def _scores(model):
    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(1)):
                part = batch.slice(low, high - low)
                yield pa.record_batch([part.column(0), pa.array(model.value.score(part.column(1)))], ["key", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7, max_rows: int = 5_000, unlabelled: int = 3_000) -> DataFrame:
    """``<id>, held_out, score, predicted`` for each row of ``docs``.

    The model sees the texts and labels of at most ``max_rows`` rows outside of the held-out fold (crc32 of the id
    as text, modulo 3, is 1), and of ``unlabelled`` documents outside of it the texts of those without a label; no other
    column. All texts are scored whole; null and empty ones get the score of no words. ``predicted`` is 1 where the score
    is at least ``threshold``. Without labels the voters are those of the lexicon. Ids may be null or repeat, each row is
    scored by its text; other columns don't matter; an empty table gives no rows.
    """
    scorer = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, max_rows=max_rows, unlabelled=unlabelled))
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    scored = rows.mapInArrow(_scores(scorer), f"key {kind}, score double")
    return scored.select(F.col("key").alias(id_col), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def fitted(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 5_000, unlabelled: int = 3_000) -> Classifier:
    found = training_rows(docs, labels, [label_col], id_col=id_col, text_col=text_col, most=max_rows, unlabelled=unlabelled)
    return train(found["text"].combine_chunks().cast(pa.large_string()), found[label_col].to_numpy().astype(float))


def _keep_below(model, threshold: float):
    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(1)):
                part = batch.slice(low, high - low)
                yield pa.record_batch([part.column(0).filter(pa.array(model.value.score(part.column(1)) < threshold))], ["row"])

    return run


def without_toxic(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", threshold: float = 0.7, **options) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, with all their columns.

    Null and empty texts are scored as in :func:`toxicity`; rows that repeat share their fate, columns may have any
    names, and an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, text_col=text_col, **options))
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("whole"))
    return rows.mapInArrow(_keep_below(model, threshold), rows.select("row").schema).select("row.*")
