"""Rules, tree and verdicts against a plain implementation that grows the tree host by host."""

import re
from collections import defaultdict
from math import sqrt

from pyspark.sql import functions as F

from parcelyard.llm import queries, urls


def parts_of(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = m.groups() if m else ("", "")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def kind(segment):
    name, end = re.fullmatch(r"(?s)(.*?)(\.[A-Za-z0-9]{1,5})?", segment).groups()
    for pattern, k in ((r"\d{4}-\d\d-\d\d", "{date}"), (r"\d+", "{n}"), (r"[0-9a-fA-F-]{16,}", "{x}"), (r"[^-_]+(?:[-_][^-_]+){3,}", "{slug}")):
        if re.fullmatch(pattern, name):
            return k + (end or "")
    return segment


def tree_by_hand(rows, many=20, variable=0.5, z=2.0, strength=8.0):
    """Template and purity of each (host, path); rows are (host, path, good)."""
    count = defaultdict(lambda: [0, 0, 0])
    for host, path, good in rows:
        c = count[host, path]
        c[0] += 1
        c[1] += good == 1
        c[2] += good == 0
    g, b = sum(c[1] for c in count.values()), sum(c[2] for c in count.values())
    total, out = (g + 1) / (g + b + 1), {}

    def grow(host, paths, node, purity, k):
        """Paths of one branch that all have a k-th segment."""
        kinds = defaultdict(list)
        for p in paths:
            kinds[kind(p.split("/")[k])].append(p)
        sums = {s: [sum(count[host, p][j] for p in some) for j in range(3)] for s, some in kinds.items()}
        n, g, b = (sum(x[j] for x in sums.values()) for j in range(3))
        pooled, branches = g / max(g + b, 1), defaultdict(list)
        for s, (_, good, bad) in sums.items():
            seen = good + bad
            alike = seen and abs(good / seen - pooled) <= z * sqrt(max(pooled * (1 - pooled), 0.0475) / seen)
            name = s
            if not s.startswith("{"):
                name = "*" if len(kinds) > many and len(kinds) > variable * n else "~" if alike and len(kinds) > 1 else s
            branches[name].append(s)
        for name, members in branches.items():
            g, b = (sum(sums[s][j] for s in members) for j in (1, 2))
            own, here = (g + strength * purity) / (g + b + strength), [p for s in members for p in kinds[s]]
            for p in here:
                if len(p.split("/")) == k + 1:
                    out[host, p] = (f"{node}/{name}", own)
            deeper = [p for p in here if len(p.split("/")) > k + 1]
            if deeper:
                grow(host, deeper, f"{node}/{name}", own, k + 1)

    hosts = defaultdict(list)
    for host, path in count:
        hosts[host].append(path)
    for host, paths in hosts.items():
        g, b = (sum(count[host, p][j] for p in paths) for j in (1, 2))
        purity = (g + strength * total) / (g + b + strength)
        for p in paths:
            if "/" not in p:
                out[host, p] = ("", purity)
        some = [p for p in paths if "/" in p]
        if some:
            grow(host, some, "", purity, 1)
    return out


def judge_by_hand(rows, rules):
    """rows are (id, url, good): host, path, rule and verdict by id."""
    cut = [(i, *parts_of(u), good) for i, u, good in rows]
    tree = tree_by_hand([x[1:] for x in cut])
    out = []
    for i, host, path, _ in cut:
        fits = [(len(h) + len(p), f"{h}/{p}", what) for what, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        rule = max(fits)[1:] if fits else (None, "allow" if tree[host, path][1] >= 0.5 else "block")
        out.append((i, host, path, rule[0], rule[1], tree[host, path][0], round(tree[host, path][1], 9)))
    return sorted(out, key=str)


def compare(spark, rows, rules=queries.URL_RULES):
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, good int, host string, node string").repartition(5)
    got = urls.judge_urls(table, rules, F.col("good")).collect()
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict, r.template, round(r.purity, 9)) for r in got), key=str) == judge_by_hand(rows, rules)


def test_given_pages(spark, data):
    """The query over a whole table, labels and all."""
    pages = spark.read.parquet(f"{data}/pages.parquet").collect()
    label = {}
    for r in spark.read.parquet(f"{data}/labels.parquet").collect():
        q, t = label.get(r.doc_id, (1, 0))
        label[r.doc_id] = (min(q, r.quality), max(t, r.toxic))
    rows = []
    for r in pages:
        m = re.search(r"(\d{1,18})(?:\.\w+)?/?$", parts_of(r.url)[1])
        of = label.get(int(m[1])) if m else None
        rows.append((r.page_id, r.url, None if of is None else int(of == (1, 0))))
    got = queries.op8_path_templates(spark, data).collect()
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=str) == sorted((x[:5] for x in judge_by_hand(rows, queries.URL_RULES)), key=str)


def test_made_pages(spark):
    from random import Random

    r = Random(8)
    rows = [(k, f"{r.choice(['http', 'x'])}://{r.choice(['a.com', 'www.EXAMPLE.com', 'b.net', 'c', ''])}" + "".join("/" + r.choice(["", "en", "es", "fr", "p", str(r.randrange(99)), f"v{r.randrange(400)}", "a-b-c-d.html", "2020-01-02", "0123456789abcdef.x"]) for _ in range(r.randrange(6))) + r.choice(["", "?q", "#f"]), r.choice([0, 1, None])) for k in range(700)]
    rows += [(1000 + k, f"http://hot/{'bad' if k % 2 else 'good'}/t{k}", k % 2 ^ 1) for k in range(200)]
    rows += [(2000, None, 1), (2001, "no scheme", None), (2002, "http://a.com", 1), (2003, "http://a.com/", 0), (None, "http://a.com/en", None), (2004, "a://b://c/d?e", 0), (2005, "http://a.com", 1)]
    compare(spark, rows)
    compare(spark, [(k, u, None) for k, u, _ in rows], [])


def test_a_rule_needs_the_start_of_the_path(spark):
    rows = [(1, "http://x.com", None), (2, "http://x.com?q", None), (3, "http://x.com/", None), (4, "http://sub.x.com/a", None), (5, "http://xcom/", None)]
    table = spark.createDataFrame(rows, "page_id long, url string, good int")
    got = {r.page_id: r.rule for r in urls.judge_urls(table, queries.URL_RULES, F.col("good")).collect()}
    assert got == {1: None, 2: None, 3: "com/", 4: "com/", 5: None}
