"""URL filters: explicit rules first, then a tree of path templates per host.

The tree of a host is grown level by level over distinct (host, path) with their label counts:

1. A segment that is made of digits, hexadecimals or a date becomes a wildcard of its kind at once; of the others, the
   children of a node become ``*`` if they are many and mostly seen once (variable names).
2. Children of a node whose share of good labels does not differ from that of all of them together by more than
   chance allows are merged into one branch, ``~``; the others stay apart.
3. A template's purity is its share of good labels, smoothed by that of its parent, which is smoothed by its own, up
   to the host and to all hosts. Templates with a purity under ``least`` are rejected.

The tree is grown to the last segment of every path. A path leaves the rounds when it ends, or when it is alone in its
branch, as the rest of its template then follows from the path itself.

Every step is a DataFrame aggregate over keys (host, node, ...) with a map-side combine, and a join back to the
distinct paths. The aggregates are written first, so that Spark knows their sizes when it plans the joins: small ones are
broadcast and the paths stay where they are; beyond the broadcast limit adaptive execution splits a host with a third
of all paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), *AZ), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest of the rules (verdict, host, path) that fits, as host and path, and its verdict; nulls if none.

    A rule fits its host and all subdomains if the path starts with ``/`` and the rule's path. So an empty path fits none.
    """
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # a longer one is put over a shorter
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(f"/{p}"))
        rule, verdict = F.when(fits, f"{h}/{p}").otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _kind(segment: Column) -> Column:
    """A segment, or the wildcard of its kind; a file's extension stays."""
    name, end = F.regexp_extract(segment, r"^(.*?)(\.[A-Za-z0-9]{1,5})?$", 1), F.regexp_extract(segment, r"^(.*?)(\.[A-Za-z0-9]{1,5})?$", 2)
    kind = F.when(name.rlike(r"^\d{4}-\d\d-\d\d$"), "{date}").when(name.rlike(r"^\d+$"), "{n}").when(name.rlike(r"^[0-9a-fA-F-]{16,}$"), "{x}").when(name.rlike(r"^[^-_]+(?:[-_][^-_]+){3,}$"), "{slug}")
    return F.when(kind.isNotNull(), F.concat(kind, end)).otherwise(segment)


def template_verdicts(urls: DataFrame, *, many: int = 20, variable: float = 0.5, z: float = 2.0, strength: float = 8.0, least: float = 0.5) -> DataFrame:
    """``host, path, template, purity, allowed`` for each distinct (host, path) of ``urls`` (host, path, good: 1, 0 or null).

    Paths are told apart by all their segments. Without any labels all purities are 1. ``strength`` is how many
    labels a parent's purity counts as.
    """
    good, bad = F.sum(F.when(F.col("good") == 1, 1).otherwise(0)), F.sum(F.when(F.col("good") == 0, 1).otherwise(0))
    leaves = urls.groupBy("host", "path").agg(F.count("*").alias("n"), good.alias("good"), bad.alias("bad"))
    leaves = leaves.withColumn("segments", F.split(F.col("path"), "/", -1)).withColumn("node", F.lit(""))
    leaves = stored(leaves, "leaves")
    every = leaves.agg(F.coalesce(F.sum("good"), F.lit(0)).alias("g"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b")).first()
    total = float(every.g + 1) / float(every.g + every.b + 1)  # one row
    host = leaves.groupBy("host").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    host = stored(host.select(F.col("host").alias("h"), ((F.col("g") + strength * total) / (F.col("g") + F.col("b") + strength)).alias("purity")), "hosts")
    leaves = stored(leaves.join(host, F.col("host") == F.col("h")).drop("h"), "leaves")
    columns = ["host", "path", F.col("node").alias("template"), "purity"]
    done = [leaves.where(F.size("segments") < 2).select(*columns)]
    leaves = leaves.where(F.size("segments") >= 2)
    k = 2
    while leaves.limit(1).count():
        now = stored(leaves.withColumn("segment", _kind(F.get("segments", F.lit(k - 1)))), "level")
        more = F.size("segments") > k
        child = now.groupBy("host", "node", "segment").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.sum(more.cast("int")).alias("paths"))
        child = stored(child, "children")
        about = stored(child.groupBy("host", "node").agg(F.count("*").alias("kinds"), F.sum("n").alias("all"), F.sum("good").alias("g"), F.sum("bad").alias("b")), "about")
        wild = (F.col("kinds") > many) & (F.col("kinds") > variable * F.col("all")) & ~F.col("segment").startswith("{")
        seen = F.col("good") + F.col("bad")
        pooled = F.col("g") / F.greatest(F.col("g") + F.col("b"), F.lit(1))
        spread = F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(0.0475)) / F.greatest(seen, F.lit(1)))
        alike = (seen > 0) & (F.abs(F.col("good") / F.greatest(seen, F.lit(1)) - pooled) <= z * spread)
        # Only branches with labels can be found alike; wildcards of a kind have their own place
        name = F.when(wild, "*").when(alike & (F.col("kinds") > 1) & ~F.col("segment").startswith("{"), "~").otherwise(F.col("segment"))
        named = child.join(about.select(F.col("host").alias("h"), F.col("node").alias("p"), "kinds", "all", "g", "b"), (F.col("host") == F.col("h")) & (F.col("node") == F.col("p"))).withColumn("name", name)
        named = stored(named.select("host", "node", "segment", "name", "good", "bad", "paths"), "named")
        counts = named.groupBy(F.col("host").alias("h2"), F.col("node").alias("p2"), F.col("name").alias("c2")).agg(F.sum("good").alias("g2"), F.sum("bad").alias("b2"), F.sum("paths").alias("paths"))
        names = named.select(F.col("host").alias("h"), F.col("node").alias("p"), F.col("segment").alias("s"), "name")
        names = names.join(stored(counts, "counts"), (F.col("h") == F.col("h2")) & (F.col("p") == F.col("p2")) & (F.col("name") == F.col("c2"))).select("h", "p", "s", "name", "g2", "b2", "paths")
        names = stored(names, "names")
        leaves = now.join(names, (F.col("host") == F.col("h")) & (F.col("node") == F.col("p")) & (F.col("segment") == F.col("s")))
        leaves = leaves.withColumn("node", F.concat("node", F.lit("/"), "name")).withColumn("purity", (F.col("g2") + strength * F.col("purity")) / (F.col("g2") + F.col("b2") + strength))
        leaves = stored(leaves.drop("h", "p", "s", "name", "g2", "b2", "segment"), "leaves")
        # The only path with further segments in its branch keeps each of them (a single child is neither "~" nor, with many >= 1, "*")
        alone = (F.col("paths") == 1) & F.lit(many >= 1)
        rest = F.slice("segments", k + 1, F.greatest(F.size("segments") - k, F.lit(0)))
        template = F.concat("node", F.lit("/"), F.array_join(F.transform(rest, _kind), "/"))
        purity = F.aggregate(rest, F.col("purity"), lambda p, _: (F.col("good") + strength * p) / (F.col("good") + F.col("bad") + strength))
        done.append(leaves.where(~more).select(*columns))
        done.append(leaves.where(more & alone).select("host", "path", template.alias("template"), purity.alias("purity")))
        leaves = leaves.where(more & ~alone).drop("paths")
        k += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.withColumn("allowed", F.col("purity") >= least)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], good: Column | None = None, *, id_col: str = "page_id", url_col: str = "url", **options) -> DataFrame:
    """``<id>, host, path, rule, verdict, template, purity`` for each row of ``pages``.

    Verdicts are "allow" or "block": the rule's, or where none fits the tree's. ``good`` is a column of ``pages``
    with 1 or 0 for labelled rows and null for others. Null URLs, and those without ``://``, have an empty host
    and path and share the template of these. Rows may repeat; other columns don't matter; an empty table
    gives no rows.
    """
    url = F.col(url_col).cast("string")
    label = F.lit(None).cast("int") if good is None else good.cast("int")
    rows = pages.select(F.col(id_col).alias("key"), host_of(url).alias("host"), path_of(url).alias("path"), label.alias("good"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = stored(rows.withColumn("rule", rule).withColumn("ruled", verdict), "urls")
    tree = template_verdicts(rows.select("host", "path", "good"), **options)
    tree = tree.select(F.col("host").alias("h"), F.col("path").alias("p"), "template", "purity", "allowed")
    both = rows.join(tree, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")))
    verdict = F.coalesce(F.col("ruled"), F.when(F.col("allowed"), "allow").otherwise("block"))
    return both.select(F.col("key").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
