"""URL filter by a path-template tree, with DataFrame functions only.

Explicit rules (host, path prefix) decide first. Their verdicts are also the labels from which the tree learns. Per host, paths form
a tree of segments, generalised from the top. A segment's runs of digits are one shape; below a node with many different children rare
ones become one wildcard; of the others, branches that may be samples of one distribution by Hoeffding's bound (of what stands
below them, and of their labels; those without labels say nothing against it) are merged into the heaviest of them. The next depth is
built on the new prefixes, so subtrees below wildcards and merged branches are pooled. Segments from DEPTH on are one. Each leaf of the
generalised tree is a template, and a template is rejected if its labelled pages are, after smoothing, nearly all blocked.

The tree is built from counts of distinct (host, shape of path), which are pre-aggregated before a shuffle and stored once; joins that
bring labels back to them and to the pages are salted, since one host or shape may have a third of all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .shared import stored

#: More children than this make a segment variable; a child of at least this share of the pages keeps its name.
MOST_CHILDREN, KEEP_SHARE = 16, 0.1
#: Levels of the tree; salts of a join; shares of children from this on are compared, by Hoeffding's bound (here at a level of 0.05).
DEPTH, SALTS, LEAST_SHARE, CONFIDENCE = 8, 16, 0.05, math.sqrt(math.log(2 / 0.05) / 2)
#: Shares of blocked labels that differ so much are never merged.
MOST_APART = 0.5
#: A template's share of blocked labels is (blocked + WEIGHT * PRIOR) / (labelled + WEIGHT); it is rejected from REJECT on.
WEIGHT, PRIOR, REJECT = 4.0, 0.5, 0.8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and for what has no `://`."""
    get = lambda k: F.coalesce(F.regexp_extract(url, PARTS, k), F.lit(""))
    return F.translate(get(1), UPPER, LOWER), get(2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none. rules: (verdict, host, path)."""
    name = verdict = None
    for what, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = (F.when(fits, h + p), F.when(fits, what)) if name is None else (name.when(fits, h + p), verdict.when(fits, what))
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def share_blocked(blocked: Column, labelled: Column) -> Column:
    return (blocked + WEIGHT * PRIOR) / (labelled + WEIGHT)


def templates(counts: DataFrame) -> DataFrame:
    """(host, shape) to template and the template's smoothed share of blocked labels. counts: host, shape, n, labelled, blocked.

    The tree is generalised from the top: at each depth the segments below a (generalised) prefix become a wildcard, a merged branch or
    themselves, and the next depth is built on the new prefixes, so what stands below a wildcard or a merged branch is pooled.
    """
    head, rest = F.slice("all", 1, DEPTH - 1), F.array_join(F.slice("all", F.lit(DEPTH), F.greatest(F.size("all") - DEPTH + 1, F.lit(0))), "/")
    segments = F.when(F.size("all") < DEPTH, F.col("all")).otherwise(F.concat(head, F.array(rest)))
    rows = counts.withColumn("all", F.split("shape", "/")).select("host", "shape", "n", "labelled", "blocked", segments.alias("segments"), F.lit("").alias("prefix"))
    rows = stored(rows, "shapes")
    levels = rows.agg(F.max(F.size("segments")).alias("x")).first().x or 0  # DEPTH at most
    for depth in range(levels):
        active = rows.where(F.size("segments") > depth).withColumn("segment", F.col("segments")[depth])
        labels = salted(labels_of(active.withColumn("next", F.coalesce(F.get("segments", F.lit(depth + 1)), F.lit("/")))))
        named = active.withColumn("salt", salt_of("shape")).join(labels, ["host", "prefix", "segment", "salt"])
        prefix = F.col("label") if depth == 0 else F.concat("prefix", F.lit("/"), "label")
        named = named.select("host", "shape", "n", "labelled", "blocked", "segments", prefix.alias("prefix"))
        rows = stored(rows.where(F.size("segments") <= depth).unionByName(named), "shapes")
    path = rows.withColumnRenamed("prefix", "template")
    purity = path.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    purity = salted(purity.select("host", "template", share_blocked(F.col("blocked"), F.col("labelled")).alias("blocked_share")))
    return path.withColumn("salt", salt_of("shape")).join(purity, ["host", "template", "salt"]).select("host", "shape", "template", "blocked_share")


def salt_of(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def salted(df: DataFrame) -> DataFrame:
    """Every row for each salt, so that the other side's rows of one key are dealt over SALTS tasks."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def labels_of(active: DataFrame) -> DataFrame:
    """(host, prefix, segment) to its label in the generalised tree. active: host, prefix, segment, next, n, labelled, blocked."""
    node, branch = ["host", "prefix"], ["host", "prefix", "segment"]
    sums = [F.sum(x).alias(x) for x in ("n", "labelled", "blocked")]
    children = stored(active.groupBy(*branch, "next").agg(*sums), "children")  # stored where used more than once, so that plans stay small
    branches = children.groupBy(*branch).agg(*sums)
    nodes = branches.groupBy(*node).agg(F.count(F.lit(1)).alias("width"), F.sum("n").alias("total"))
    branches = stored(branches.join(nodes, node).withColumn("wild", (F.col("width") > MOST_CHILDREN) & (F.col("n") < KEEP_SHARE * F.col("total"))), "branches")
    # Named branches are at most MOST_CHILDREN, or 1 / KEEP_SHARE, of a node; their profiles at most 1 / LEAST_SHARE shares each.
    named = branches.where("not wild").select(*branch, "n", "labelled", "blocked")
    shares = children.select(*branch, "next", F.col("n").alias("m")).join(named.select(*branch, "n"), branch).withColumn("share", F.col("m") / F.col("n")).where(F.col("share") >= LEAST_SHARE)
    profiles = shares.groupBy(*branch).agg(F.map_from_entries(F.collect_list(F.struct("next", "share"))).alias("profile"))
    named = stored(named.join(profiles, branch, "left").withColumn("profile", F.coalesce("profile", F.expr("cast(map() as map<string,double>)"))), "named")
    one = F.struct("n", "segment", "labelled", "blocked", "profile")
    a, b = named.select(*node, one.alias("a")), named.select(*node, one.alias("b"))
    heavier = (F.col("b.n") > F.col("a.n")) | ((F.col("b.n") == F.col("a.n")) & (F.col("b.segment") < F.col("a.segment")))
    pairs = a.join(b, node).where(heavier & alike(F.col("a"), F.col("b")))  # of the few named branches of a node
    pairs = pairs.select(*node, F.col("a.segment").alias("segment"), F.struct(F.col("b.n").alias("n"), F.col("b.segment").alias("leader")).alias("to"))
    pairs = stored(pairs, "pairs")
    followers = pairs.select(*branch).distinct()
    leaders = followers.select(*node, F.col("segment").alias("leader"))
    merged = pairs.withColumn("leader", F.col("to.leader")).join(leaders, [*node, "leader"], "left_anti").groupBy(*branch).agg(F.max("to").alias("to")).select(*branch, F.col("to.leader").alias("leader"))
    heads = merged.select(*node, F.col("leader").alias("segment")).distinct().withColumn("head", F.lit(True))
    found = branches.select(*branch, "wild").join(merged, branch, "left").join(heads, branch, "left")
    label = F.when(F.col("wild"), "*").when(F.col("leader").isNotNull(), F.concat(F.lit("{"), "leader", F.lit(",..}"))).when(F.col("head"), F.concat(F.lit("{"), "segment", F.lit(",..}"))).otherwise(F.col("segment"))
    return stored(found.select(*branch, label.alias("label")), "labels")


def alike(a: Column, b: Column) -> Column:
    """Whether two branches may be samples of one: no share of a child, nor that of blocked labels (if both have any), differs by more
    than Hoeffding's bound for their numbers allows, and labels differ by less than MOST_APART in any case."""
    bound = lambda n, m: CONFIDENCE * (1 / F.sqrt(n) + 1 / F.sqrt(m))
    near = lambda x, y: F.forall(F.map_entries(x["profile"]), lambda e: F.abs(e["value"] - F.coalesce(F.try_element_at(y["profile"], e["key"]), F.lit(0.0))) <= bound(a["n"], b["n"]))
    blank = (a["labelled"] == 0) | (b["labelled"] == 0)
    apart = F.abs(a["blocked"] / F.nullif(a["labelled"], F.lit(0)) - b["blocked"] / F.nullif(b["labelled"], F.lit(0)))
    agree = F.when(blank, F.lit(True)).otherwise((apart < MOST_APART) & (apart <= bound(F.greatest(a["labelled"], F.lit(1)), F.greatest(b["labelled"], F.lit(1)))))
    return near(a, b) & near(b, a) & agree


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: page_id, host, path, rule, verdict (allow or block), template, blocked_share.

    A null url and one without `://` have an empty host and path, which form a template of their own. Repeated rows stay and count as
    often. An empty table gives an empty one. Other columns are ignored. The rules are a short list (they become one expression).
    """
    host, path = host_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    shape = F.regexp_replace(F.regexp_replace("path", "[0-9]+", "#"), "^/", "")
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), shape.alias("shape"))
    counts = rows.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count("ruled").alias("labelled"), F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked"))
    found = rows.withColumn("salt", salt_of("page_id")).join(salted(templates(stored(counts, "counts"))), ["host", "shape", "salt"])
    learned = F.when(F.col("blocked_share") >= REJECT, "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), "template", "blocked_share")
