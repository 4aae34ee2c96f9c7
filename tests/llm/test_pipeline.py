"""The stages of the pipeline, one after the other, against plain versions of what each decides."""

import collections
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from parcelyard import storage  # noqa: E402
from parcelyard.llm import simple8b, toxicity  # noqa: E402
from parcelyard.llm.queries import tokenizer_path  # noqa: E402

SPACE = "".join(map(chr, [0x20, *range(0x09, 0x0E)]))
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
UPPER = {small: large for large, small in LOWER.items()}  #: other letters count as they are written


def words(text, inside):
    out, word = [], ""
    for c in (text or "").translate(LOWER) + " ":
        if inside(c):
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def windows(w, n):
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def one_of_each(docs):
    """Ids of the smallest document of each group linked by sets of five words at 0.8, all pairs compared."""
    sets = {i: windows(words(t, lambda c: c not in SPACE), 5) for i, t in docs.items()}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i for i in ids if find(i) == i}


@pytest.fixture(scope="module")
def corpus(spark, data, tmp_path_factory):
    """The smallest tables, with planted near copies, benchmark passages, and odd texts."""
    folder = tmp_path_factory.mktemp("corpus")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    item = spark.read.parquet(f"{data}/benchmark.parquet").where("text is not null").orderBy(F.desc(F.length("text"))).first().text
    base = max((r.text for r in docs.where("text is not null").collect()), key=len)
    some = docs.first().asDict()
    odd = [None, "", base, base + " end", base.translate(UPPER), f"some words before {item} and after", "short text"]
    planted = spark.createDataFrame([{**some, "doc_id": 9_000_000 + k, "text": t} for k, t in enumerate(odd)], docs.schema)
    docs.unionByName(planted).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{data}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_each_stage(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    tables = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = storage.stored(stage(spark, before, corpus), "test-stage")
        tables[name] = before, docs
        if name != "token_ids":
            assert docs.columns == before.columns
    rows = {name: ([tuple(r) for r in x.collect()], [tuple(r) for r in y.collect()]) for name, (x, y) in tables.items()}
    place = {c: k for k, c in enumerate(spark.read.parquet(f"{corpus}/documents.parquet").columns)}
    texts = {name: {r[place["doc_id"]]: r[place["text"]] for r in x} for name, (x, _) in rows.items()}
    left = {name: {r[place["doc_id"]] for r in y} for name, (_, y) in rows.items() if name != "token_ids"}

    scored = toxicity.toxicity(tables["toxicity"][0], spark.read.parquet(f"{corpus}/labels.parquet"), threshold=0.7).collect()
    assert left["toxicity"] == {r.doc_id for r in scored if not r.predicted}
    assert 0 < len(left["toxicity"]) < len(scored)

    assert left["near_duplicates"] == one_of_each(texts["near_duplicates"])
    assert not left["near_duplicates"] & {9_000_003, 9_000_004} or 9_000_002 not in left["toxicity"]

    alnum = lambda c: c.isascii() and c.isalnum() or ord(c) >= 0x80
    items = [words(r.text, alnum) for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    found = collections.defaultdict(set)
    for w in items:
        found[min(len(w), 10)] |= windows(w, 10)
    clean = {i for i, t in texts["decontamination"].items() if not any(n and len(w := words(t, alnum)) >= n and windows(w, n) & found[n] for n in found)}
    assert left["decontamination"] == clean and 9_000_005 not in clean

    kept = collections.Counter(r[place["doc_id"]] for r in rows["mixing"][0])
    mixed = collections.Counter(r[place["doc_id"]] for r in rows["mixing"][1])
    assert set(mixed) <= set(kept) and all(n <= 2 * kept[i] for i, n in mixed.items())
    assert set(map(repr, rows["mixing"][1])) <= set(map(repr, rows["mixing"][0]))
    size = {i: len(words(t, lambda c: c not in SPACE)) for i, t in texts["mixing"].items()}
    target = 1.5 * sum(size.values())
    assert abs(sum(size[i] * n for i, n in mixed.items()) - target) <= 6 * max(size.values()) or target > 2 * sum(size.values())

    library = simple8b.tokenizer(tokenizer_path()).library
    want, start = [], 0
    for i, text in sorted((r[place["doc_id"]], r[place["text"]] or "") for r in rows["token_ids"][0]):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(rows["token_ids"][1], key=lambda r: r[1]) == want


def test_run_is_its_stages_and_leaves_its_last_table_only(spark, corpus):
    root = Path(storage.shared_dir(spark).removeprefix("file://")) / "parcelyard"
    before = {p.name for p in root.iterdir()} if root.exists() else set()
    got = corpus_pipeline.run(spark, corpus)
    left = sorted(p.name.rsplit("-", 1)[0] for p in root.iterdir() if p.name not in before)
    assert left == ["stage-token_ids", "tokens"]
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 0
