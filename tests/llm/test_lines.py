"""Line rules and verdicts against a plain second implementation over whole tables and odd rows."""

import re
import time
from collections import Counter

import pytest

from parcelyard.llm import lines, queries

WORD = re.compile("[^\x20\x09-\x0d]+")
ENDS = tuple(".!?…。！？:;")


def rule_by_hand(line):
    w = line.split()
    if not w:
        return None
    bars = sum(x in ("|", "»", "›", ">", "•", "·") for x in w)
    if bars >= 2 and bars * 5 >= len(w):
        return "navigation"
    if "{" in line or "}" in line or re.search(r"</?\w+[^>]*>", line):
        return "code"
    if 10 * sum(any(c in "#*$%&|<>" for c in x) for x in w) > len(w):
        return "symbols"
    if any(p in line.lower() for p in lines.BOILERPLATE):
        return "boilerplate"
    if len(w) >= 4:
        if 2 * Counter(w).most_common(1)[0][1] > len(w):
            return "repeats"
        if 10 * sum(x.isupper() for x in w) > 6 * len(w) or 10 * sum(x.endswith("!!") for x in w) > 6 * len(w):
            return "shouting"
    bare = line.rstrip().rstrip("\"'”’»)]")
    if bare.endswith(ENDS):
        return None
    inside = re.search(r"[.!?…][\"'”’»)\]]*\s", line) or re.search("[。！？]", line)
    return None if len(w) >= 12 and inside else "punctuation"


def verdict_by_hand(text):
    w = WORD.findall(text or "")
    c = Counter(zip(w, w[1:], w[2:]))
    m = [any(c[tuple(w[j : j + 3])] > 1 for j in range(max(0, k - 2), k + 1) if j + 3 <= len(w)) for k in range(len(w))]
    failed = len(w) < 50 or 100 * sum(m) > 50 * len(w)
    total = lost = 0
    kept = []
    for line in (text or "").split("\n"):
        n = sum(map(len, line.split()))
        total += n
        if rule_by_hand(line):
            lost += n
        else:
            kept.append(line)
    return failed, not failed and lost <= 0.3 * total, "\n".join(kept)


LINES = [
    "Home page of the site here", "A sentence that ends. Then text goes on for a good while and is cut of", "Short. But no end", "He said “no.”", "Ende (wirklich!)", "Cliquez ici pour lire la suite.", "Das Impressum finden Sie hier.",
    "Todos los derechos reservados.", "a a a b", "a a b b.", "A B C D e.", "go!! go!! go!! now.", "x | y | z", "a > b > c", "1 < 2 and 3 > 2 is so.", "<b>bold</b>", "fn() { }", "one # two three four five six seven eight nine ten.", "日本語の文。続き", "", "   ", "end:", "…", "\tTabs\tand words.\t",
]


@pytest.mark.parametrize("line", LINES)
def test_rules_equal_a_plain_implementation(line):
    assert lines.line_fails(line) == rule_by_hand(line)


@pytest.mark.parametrize("line, rule", [("Home page of the site here", "punctuation"), ("Cliquez ici pour lire la suite.", "boilerplate"), ("Das Impressum finden Sie hier.", "boilerplate"), ("Todos los derechos reservados.", "boilerplate"), ("He said “no.”", None), (LINES[1], None)])
def test_rules_by_case(line, rule):
    assert lines.line_fails(line) == rule


def test_verdicts_equal_a_plain_implementation(spark, data):
    got = queries.op9_line_cleaning(spark, data).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    assert {r.doc_id: (r.base_failed, r.kept) for r in got} == {k: verdict_by_hand(t)[:2] for k, t in texts.items()}
    good = "Here are some words that make up a line of running text. " * 6
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "\n".join(f"{good[: 40 + k]} {k}." for k in range(9))), (5, "\n".join([f"{good}{k}." for k in range(3)] + LINES)), (None, "x\r\ny"), (5, "menu | of | things\n" * 40), (6, "é ü " * 90)]
    out = lines.line_quality(spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, kept boolean")).collect()
    assert sorted(((r.doc_id, r.base_failed, r.kept, r.cleaned) for r in out), key=str) == sorted(((i, *verdict_by_hand(t)) for i, t in rows), key=str)


def test_long_lines_take_time_by_their_length():
    began = time.time()
    assert lines.line_fails(" ".join(f"w{k % 100_000}" for k in range(200_000)) + ".") is None
    assert time.time() - began < 2
