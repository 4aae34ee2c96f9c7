"""Nulls, empty and long texts, ties, repeats, empty tables and clashing names; brute force on small fixtures."""

import collections
import hashlib
import io
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelyard.llm import chat, jaccard, lines, quality, queries, simple8b, toxicity, urls, warc

WORD = re.compile("[^\x20\x09-\x0d]+")
CLASH = "doc_id long, text string, source string, n_words int, key string, id int, h string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, "k", 2, "h") for r in rows], CLASH)


ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (4, "one"), (None, "A b, c d."), (6, "x " * 40_000), (7, "é ü ß 日本 " * 30), (8, "Fine words are here. " * 20)]


def near(n, salt=0):
    base = [f"w{k * 31 % 97}" for k in range(n)]
    for k in range(salt):
        base[(k * 13) % n] = f"z{salt}{k}"
    return " ".join(base)


def classes_by_hand(rows, n, num, den):
    sets = []
    for i, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((i, frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()))
    parent = list(range(len(sets)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                parent[top(a)] = top(b)
    groups = collections.defaultdict(list)
    for k in range(len(sets)):
        groups[top(k)].append(k)
    out = []
    for some in groups.values():
        ids = [sets[k][0] for k in some if sets[k][0] is not None]
        out += [(sets[k][0], len(sets[k][1]), min(ids, default=None)) for k in some]
    return sorted(out, key=str)


def test_jaccard_join(spark):
    rows = [*ODD, *((100 + k, near(120, k % 7)) for k in range(30)), *((200 + k, near(40 + k)) for k in range(20)), (300, near(120).upper()), (301, "a b c"), (302, "A B C")]
    for n, num in ((4, 85), (5, 80)):
        got = jaccard.near_duplicate_classes(docs(spark, rows).repartition(5), shingle=n, num=num)
        assert sorted(map(tuple, got.collect()), key=str) == classes_by_hand(rows, n, num, 100)
    left = jaccard.keep_one_of_each(docs(spark, rows))
    want = {i for i, _, c in classes_by_hand(rows, 5, 80, 100) if i is None or i == c}
    assert {r.doc_id for r in left.collect()} == want and left.columns == docs(spark, []).columns
    assert jaccard.near_duplicate_classes(docs(spark, [])).count() == 0


def test_jaccard_links(spark):
    rows = [*ODD, *((100 + k, near(120, k % 7)) for k in range(30)), *((200 + k, near(40 + k)) for k in range(20)), (300, near(120).upper())]
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").lower())
        if w:
            x = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
            sets[x] = min(i if i is not None else 999, sets.get(x, 999))
    want = {(min(i, j), max(i, j)) for x, i in sets.items() for y, j in sets.items() if i != j and 100 * len(x & y) >= 80 * len(x | y)}
    got = [(min(r.id_a, r.id_b), max(r.id_a, r.id_b)) for r in jaccard.near_duplicate_links(docs(spark, rows).repartition(5)).collect()]
    assert len(want) > 100 and len(got) == len(set(got)) and set(got) == want
    assert jaccard.near_duplicate_links(docs(spark, [])).count() == 0


def test_line_counts(spark):
    def by_hand(x):
        w = WORD.findall(x or "")
        c = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        m = [any(c[tuple(w[j : j + 3])] > 1 for j in range(max(0, k - 2), k + 1) if j + 3 <= len(w)) for k in range(len(w))]
        seen, dup = set(), 0
        for line in (x or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in x or ""), dup, sum(m)

    rows = [r for r in ODD if r[0] != 6] + [(9, "a b c a b c\na b c\n a b c\na b c"), (10, "x | y | z # <b>")]
    got = lines.line_quality(docs(spark, rows)).collect()
    key = lambda r: str(r)
    assert sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got], key=key) == sorted([(i, *by_hand(x)) for i, x in rows], key=key)
    assert all(not r.kept for r in got if r.base_failed)
    assert lines.line_quality(docs(spark, [])).count() == 0


@pytest.mark.parametrize("line, rule", [("Home | News | About | Contact", "navigation"), ("All rights reserved by us.", "boilerplate"), ("if (x) { return; }", "code"), ("buy### now$$$ cheap%%%", "symbols"), ("spam spam spam spam ham", "repeats"), ("BUY THIS THING NOW!!", "shouting"), ("Read on", "punctuation"), ("A normal line of text, with an end.", None), ("", None)])
def test_line_rules(line, rule):
    assert lines.line_fails(line) == rule


def test_token_files(spark):
    tk = simple8b.tokenizer(queries.tokenizer_path())
    rows = [*ODD, (-5, "a  b\n\n c<|endoftext|> d\x1c \t"), (12, "x" * 300_000)]
    shards = simple8b.write_tokens(docs(spark, rows), queries.tokenizer_path(), shard_ids=500)
    got = simple8b.read_tokens(shards, docs(spark, []).schema["doc_id"].dataType).orderBy("start").collect()
    start, want = 0, []
    for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tk.library.encode(x or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    assert simple8b.read_tokens(simple8b.write_tokens(docs(spark, []), queries.tokenizer_path()), docs(spark, []).schema["doc_id"].dataType).count() == 0


def test_simple8b_round_trip_and_damage():
    r = np.random.default_rng(3)
    for ids in (np.zeros(1000), r.integers(0, 2, 777), r.integers(0, 50257, 5000), np.array([0, 2**63 + 5, 1, 2**60]), np.zeros(0)):
        ids = ids.astype(np.uint64)
        packed, _, escapes = simple8b.encode(ids)
        assert (simple8b.decode(packed, len(ids), escapes) == ids).all()
    body = simple8b.shard_bytes(np.arange(3000), np.array([1000, 2000]), ["1", "2"])
    assert (simple8b.Shard(body).ids(500, 2500) == np.arange(500, 2500)).all()
    with pytest.raises(ValueError):
        simple8b.Shard(body[:100] + b"\0" + body[101:])


def test_warc_round_trip(spark):
    long = "é<p>" * 60
    rows = [(3, "http://a/\r\nx", long), (1, "http://b/", long), (2, None, "short"), (5, "u", "short"), (6, "u", None), (7, "u", long + "!"), (1, "v", long)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").repartition(3)
    files = warc.write_warc(pages)
    for split in (64 << 20, 100):
        got = warc.read_warc(files, split=split).collect()
        assert not [r for r in got if r.gap]
        want = sorted((str(i), len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if i == 3 else "response", "1" if i == 3 else None) for i, _, h in rows)
        assert sorted((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert warc.read_warc(warc.write_warc(pages.limit(0))).count() == 0


@pytest.mark.parametrize("level", [1, None])
def test_warc_salvage(level):
    some = [warc.record("response", f"urn:page:{k}", {"Content-Type": "text/plain"}, bytes([65 + k]) * 300, level) for k in range(6)]
    starts = np.cumsum([0, *map(len, some)]).tolist()
    body = bytearray(b"".join(some))
    body[starts[2] + len(some[2]) // 2] ^= 0xFF
    body = bytes(body[: starts[4]]) + b"junk" * 10 + bytes(body[starts[4] : starts[5] + 20])
    out = list(warc.salvage(io.BytesIO(body), len(body)))
    names = [x.headers["warc-record-id"][-2] for x in out if isinstance(x, warc.Record)]
    gaps = [(x.start, x.end) for x in out if isinstance(x, warc.Gap)]
    assert names == list("0134") and len(gaps) == 3
    assert sum(x.end - x.start for x in out) == len(body)
    cuts = [0, 77, 400, 500, len(body)]
    parts = [x for a, b in zip(cuts, cuts[1:]) for x in warc.salvage(io.BytesIO(body), len(body), a, b)]
    assert [x.headers["warc-record-id"][-2] for x in parts if isinstance(x, warc.Record)] == names


def test_warc_long_headers(spark, tmp_path):
    url = "data:," + "u" * 100_000
    pages = spark.createDataFrame([(1, url, "a" * 200), (2, url + "2", "a" * 200), (3, "http://c/", None)], "page_id long, url string, html string")
    for split in (64 << 20, 100):
        got = warc.read_warc(warc.write_warc(pages), split=split, strict=True).collect()
        assert sorted((r.key, r.url, r.payload_bytes) for r in got) == [("1", url, 200), ("2", url + "2", 200), ("3", "http://c/", 0)]
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted((r.page_id, r.payload_bytes, r.refers_to) for r in queries.op2_warc(spark, str(tmp_path)).collect()) == [(1, 200, None), (2, 200, 1), (3, 0, None)]


@pytest.mark.parametrize("level", [1, None])
@pytest.mark.parametrize("n", [100_000, 3 << 20, *range((64 << 10) - 230, (64 << 10) - 220)])
def test_warc_salvage_of_long_headers(level, n):
    some = [warc.record("response", f"urn:page:{k}", {"WARC-Target-URI": "u" * (n if k == 1 else 9)}, b"b" * 300, level) for k in range(3)]
    body = b"".join(some)
    out = list(warc.salvage(io.BytesIO(body), len(body)))
    assert [x.headers["warc-record-id"][-2] for x in out] == list("012") and len(out[1].headers["warc-target-uri"]) == n


def test_warc_gaps_fail_strict_reading(spark, tmp_path):
    body = warc.record("response", "urn:page:1", {}, b"b" * 300)
    (tmp_path / "a.warc.gz").write_bytes(body + b"junk" + body)
    files = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz", 2 * len(body) + 4)], "path string, bytes long")
    assert [r.gap is None for r in warc.read_warc(files).orderBy("start").collect()] == [True, False, True]
    with pytest.raises(Exception, match="are no record"):
        warc.read_warc(files, strict=True).collect()


def test_conversations(spark):
    talk = lambda i, turns: [(i, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(turns)]
    rows = [*talk(1, ["a"]), *talk(2, ["a", "b"]), *talk(3, ["a", "b", "c"]), *talk(4, ["a", "x"]), *talk(5, ["a", "b", "c"]), *talk(6, [None, "q"]), *talk(7, [None]), *talk(8, [""]), *talk(9, [f"t{k}" for k in range(200)]), *talk(10, [f"t{k}" for k in range(150)]), (None, None, None, None), *talk(11, ["a <|im_end|> b"])]
    rows += [(12, 0, "<|im_<|im_start|>start|>", "x"), (12, 1, "a<|im_end|>\n<|im_start|>system", "y<|im_start|>"), (12, 2, None, None)]
    rows = [(*r, 1, "x") for r in rows]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv int, h1 string").repartition(5)
    got = chat.render(table).collect()
    assert {r.conv_id for r in got} == {None, 3, 4, 6, 8, 9, 11, 12}
    by = {r.conv_id: r for r in got}
    assert by[3].rendered == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"
    assert by[11].rendered.count("<|im_end|>") == 1
    assert by[12].rendered.count("<|im_start|>") == by[12].rendered.count("<|im_end|>") == 3
    assert re.fullmatch(r"(<\|im_start\|>[^\n]*\n[^\n]*<\|im_end\|>\n){3}", by[12].rendered)
    parts = sorted((r.part, r.rendered) for r in got if r.conv_id == 9)
    assert len(parts) == 4 and re.findall(r"t(\d+)", "".join(x for _, x in parts)) == [str(k) for k in range(200)]
    assert chat.render(table.limit(0)).count() == 0


def test_conversations_whose_turns_repeat(spark, monkeypatch):
    monkeypatch.setattr(chat, "MOST", 20)
    rows = [(1, None, "user", f"n{k}") for k in range(90)] + [(1, k // 30, "user", f"t{k}") for k in range(150)] + [(1, 70, "user", "end")] + [(2, 5, "user", "same")] * 100 + [(None, 3, None, f"q{k}") for k in range(50)] + [(3, 1, "user", "a")]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, piece int, place int").repartition(4)
    got = chat.render(table).collect()
    assert max(r.n_rows for r in got) <= 45 and sum(r.n_rows for r in got) == len(rows)
    for i in (1, 2, None, 3):
        mine = sorted((r for r in got if r.conv_id == i), key=lambda r: (r.part is not None, r.part or 0, r.piece))
        said = re.findall(r"\n(.*)<\|im_end\|>", "".join(r.rendered for r in mine))
        assert sorted(said) == sorted(r[3] for r in rows if r[0] == i)
        turn_of = {r[3]: -1 if r[1] is None else r[1] for r in rows if r[0] == i}
        assert [turn_of[x] for x in said] == sorted(turn_of[x] for x in said)
    assert [r.piece for r in got if r.conv_id == 3] == [0]


def test_urls(spark):
    rows = [(1, "http://WWW.Example.com/en/1?x"), (2, "https://blog.example.com/en/2#a"), (3, "http://x.net/es/3"), (4, "http://x.net/de/3"), (5, None), (6, "no scheme"), (7, "http://notexample.com"), (8, "http://x.net/esp"), (9, "a://b://c/d?e")]
    rows += [(100 + k, f"http://h.org/bad/{k}") for k in range(40)] + [(200 + k, f"http://h.org/good/{k}") for k in range(40)]
    table = spark.createDataFrame([(*r, 0 if 100 <= r[0] < 140 else 1 if r[0] >= 200 else None, "x") for r in rows], "page_id long, url string, good int, host string")
    got = {r.page_id: r for r in urls.judge_urls(table, queries.URL_RULES, F.col("good")).collect()}
    assert [(got[k].host, got[k].path, got[k].rule, got[k].verdict) for k in range(1, 10)] == [
        ("www.example.com", "/en/1", "www.example.com/en/", "allow"), ("blog.example.com", "/en/2", "example.com/en/", "block"), ("x.net", "/es/3", "net/es/", "block"), ("x.net", "/de/3", None, "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("notexample.com", "", None, "allow"), ("x.net", "/esp", None, "allow"), ("b:", "//c/d", None, "allow"),
    ]
    assert {got[k].verdict for k in range(100, 140)} == {"block"} and {got[k].verdict for k in range(200, 240)} == {"allow"}
    assert got[100].template == "/bad/{n}"
    assert urls.judge_urls(table.limit(0), queries.URL_RULES, F.col("good")).count() == 0


def test_deep_urls(spark):
    deep = lambda k, end: f"http://h.org/1/2/3/4/5/6/{end}/{k}"
    rows = [(k, deep(k, "bad"), 0) for k in range(40)] + [(100 + k, deep(k, "good"), 1) for k in range(40)]
    rows += [(200 + k, f"http://i.org/a/b/c/d/e/f/g/h/i/{'bad' if k % 2 else 'good'}/j/{k}/x.html", k % 2 ^ 1) for k in range(80)]
    rows += [(300, "http://i.org/a/b/c/d/e/f/g/h/i/bad/j/400/x.html", None), (301, "http://i.org/a/b/c/d/e/f/g/h/i/good/j/k/l/m/1/2024-01-01/", None)]
    rows += [(302, "http://k.org" + "/s" * 300, 1), (303, "http://m.org/t/7/8", 0), (304, "http://j.org/t", 1), (305, "http://j.org/", None)]
    table = spark.createDataFrame(rows, "page_id long, url string, good int")
    got = {r.page_id: r for r in urls.judge_urls(table, [], F.col("good")).collect()}
    assert len(got) == len(rows)
    assert all(r.verdict == ("allow" if good else "block") for k, _, good in rows[:160] for r in [got[k]])
    assert got[0].template == "/{n}/{n}/{n}/{n}/{n}/{n}/bad/{n}" and got[300].verdict == "block" and got[301].verdict == "allow"
    assert got[300].template == "/a/b/c/d/e/f/g/h/i/bad/j/{n}/x.html" and got[301].template == "/a/b/c/d/e/f/g/h/i/good/j/k/l/m/{n}/{date}/"
    assert got[302].template == "/s" * 300 and got[303].template == "/t/{n}/{n}" and got[302].purity > 0.99


def test_classifiers_on_odd_rows(spark):
    rows = ODD + [(50 + k, f"you are an idiot and a moron number {k}, pathetic scum.") for k in range(40)] + [(100 + k, f"a fine day in town number {k} with friends and tea.") for k in range(80)]
    labels = spark.createDataFrame([(i, 1, int(50 <= (i or 0) < 90)) for i, _ in rows if i and i >= 50] + [(None, 1, 1), (60, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs(spark, rows), labels).collect()}
    assert all(got[k].predicted == 1 for k in range(50, 90)) and all(got[k].predicted == 0 for k in range(100, 180))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.toxicity(docs(spark, []), labels).count() == 0
    assert toxicity.toxicity(docs(spark, rows), labels.limit(0)).count() == len(rows)
    left = toxicity.without_toxic(docs(spark, rows), labels)
    assert left.columns == docs(spark, []).columns and {r.doc_id for r in left.collect()} == {i for i, _ in rows if not (i and 50 <= i < 90)}
    ratings = labels.select("doc_id", (2 - 2 * F.col("toxic")).alias("grade"))
    graded = {r.doc_id: r for r in quality.grade_documents(docs(spark, rows), ratings).collect()}
    assert all(graded[k].kept for k in range(100, 180)) and all(not graded[k].kept for k in range(50, 90))
    assert quality.grade_documents(docs(spark, rows), ratings.limit(0)).count() == len(rows)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    scored = queries.op5_weak_toxicity(spark, d).where("held_out").join(labels, "doc_id").toPandas()
    hit = ((scored.predicted == 1) & (scored.toxic == 1)).sum()
    assert hit / (scored.predicted == 1).sum() > 0.95 and hit / (scored.toxic == 1).sum() > 0.7
    graded = queries.op3_ordinal_quality(spark, d).where("held_out").join(labels, "doc_id").toPandas()
    assert ((graded.kept) == (graded.quality == 1)).mean() > 0.95


def test_thresholds_are_ordered_and_tails_fall():
    model = quality.fit(quality.Sparse(3, np.array([0, 1, 2], np.int32), np.array([5, 6, 7], np.int32), np.ones(3, np.float32)), np.array([0, 1, 2]), 3, steps=20)
    assert (np.diff(model.thresholds) > 0).all()


def test_token_files_keep_any_id(spark):
    rows = [("", "a"), (None, None), (None, "b c"), ("two\nlines", "d"), ('"q"', ""), ("z", "e"), ("z", "e"), ("\\", "f")] + [("hot", f"text {k}") for k in range(60)] + [("hot", "same")] * 60
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id string, text string, tie string, key int").repartition(6)
    tk = simple8b.tokenizer(queries.tokenizer_path()).library
    shards = simple8b.write_tokens(table, queries.tokenizer_path(), shard_ids=40)
    got = simple8b.read_tokens(shards, table.schema["doc_id"].dataType).orderBy("start").collect()
    crc = lambda t: zlib.crc32(np.array([*tk.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert sorted(((r.doc_id, r.ids_crc32) for r in got), key=str) == sorted(((i, crc(t)) for i, t in rows), key=str)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or ""))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()


def test_stages_keep_clashing_columns(spark):
    from parcelyard.llm import decontaminate, mixing

    names = "_id _source _copies _copy _gone _row _whole row id of from size words gone kept digest whole text2 deal key copies parts".split()
    rows = [(k, f"some words of text number {k} " * 3, "ab"[k % 2], *[k] * len(names)) for k in range(12)] + [(None, None, None, *[99] * len(names))]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    items = spark.createDataFrame([(1, "number 5")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    for out in (mixing.mixed_documents(table), jaccard.keep_one_of_each(table), decontaminate.decontaminated(table, items), decontaminate.decontaminated(table, items.union(items.selectExpr("9L", "'number 6'")), block_bytes=9), toxicity.without_toxic(table, labels)):
        assert out.columns == table.columns
        assert all(r == rows[r.doc_id if r.doc_id is not None else -1] for r in out.collect())
        assert out.count() and jaccard.keep_one_of_each(out.limit(0)).count() == 0
    assert {r.doc_id for r in decontaminate.decontaminated(table, items).collect()} == {None, *range(12)} - {5}
