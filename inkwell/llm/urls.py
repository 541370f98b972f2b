"""URL filter: rules first, then a tree of path templates whose branches are judged by the purity of their labelled pages.

The rules' own verdicts are the labels. For each host, and once over all hosts, a tree of paths is made:

1. Numbers, hashes and names with digits are generalised in each segment.
2. A literal segment that is rare among its siblings and has few labelled pages becomes a wildcard. Where a path has its first
   wildcard it leaves the literal tree; its later segments are judged by their place, among all paths that left there. So all depths
   are decided in two aggregations, and the number of jobs doesn't depend on the longest path.
3. Branches with one parent are merged where their block shares are alike: first those in the same of ``CELLS`` cells of the share's
   scale, then neighbouring cells that a two-proportion test doesn't tell apart, whether or not they are like their parent.
4. The share of a branch is smoothed towards its parent's; a page is blocked from a share of ``BLOCK`` on.

Everything is counted per host and template before it is compared, so a host with a third of all pages is a few rows; a path is a row
for each segment, never a row for each prefix with its text.

Cases: a null url or one without ``://`` has an empty host and path; a branch without labelled pages has its parent's share; a page
that no rule fits and whose templates have no labelled page anywhere gets the share of all labelled pages, and without any is allowed;
repeated rows get a row each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import cut, table

#: (verdict, host, path): fits the host and its subdomains if the page's path starts with the rule's; the longest wins.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: A literal segment stays as it is from this share of its parent's pages on, or from so many labelled pages.
LEAST_SHARE, LEAST_LABELLED = 0.05, 5
#: Weight of the parent's share, in pages; z of the test; share from which a page is blocked.
PRIOR, Z, BLOCK = 5.0, 1.96, 0.5
#: Cells of the scale of shares, and where they meet: even steps of the angle whose sine is the root of the share, which has the same
#: spread everywhere. One of them is a half.
CELLS = 16
BORDERS = [round(math.sin(k * math.pi / (2 * CELLS)) ** 2, 6) for k in range(1, CELLS)]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as host and path, and its verdict; null without one. The rules are a parameter, so they are few."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """A path's segments with variable ones generalised."""

    def general(s: Column) -> Column:
        return (
            F.when(s.rlike(r"^[0-9]+$"), "{n}")
            .when(s.rlike(r"^[0-9]+\.[A-Za-z0-9]+$"), F.concat(F.lit("{n}"), F.regexp_extract(s, r"\.[A-Za-z0-9]+$", 0)))
            .when(s.rlike(r"^[0-9a-fA-F-]{12,}$"), "{hash}")
            .when(s.rlike(r"[0-9]"), "{name}")
            .otherwise(s)
        )

    return F.transform(F.filter(F.split(path, "/", -1), lambda s: s != ""), general)


def _nodes(steps: DataFrame) -> DataFrame:
    """steps (tree, leaf, at, segment) with node and parent: 128 bits that stand for the path up to this segment, and up to the one
    before. A running exclusive or of hashes of place and segment, so long paths take no more than their length."""
    way = Window.partitionBy("tree", "leaf").orderBy("at")
    hashes = {"x": F.xxhash64("at", "segment"), "y": F.xxhash64("segment", F.lit("y"), "at")}
    upto = {k: F.bit_xor(h).over(way) for k, h in hashes.items()}
    return steps.withColumn("node", F.struct(*[c.alias(k) for k, c in upto.items()])).withColumn("parent", F.struct(*[F.col(f"node.{k}").bitwiseXOR(h).alias(k) for k, h in hashes.items()]))


def _rare(counts: DataFrame, within: list[str]) -> DataFrame:
    """Of counts (within, segment, pages, n) those that are neither a class of segments, nor frequent in their group, nor labelled often."""
    total = counts.groupBy(*within).agg(F.sum("pages").alias("total"))
    return counts.join(total, within).where((F.col("pages") < LEAST_SHARE * F.col("total")) & (F.col("n") < LEAST_LABELLED) & ~F.col("segment").startswith("{"))


def generalise(leaves: DataFrame) -> DataFrame:
    """leaves (tree, leaf, shape, pages, n, b) as rows of template steps: tree, leaf, n, b, at (from 0), segment, node, parent. Paths
    without segments have none."""
    steps = cut(_nodes(leaves.select("tree", "leaf", "pages", "n", "b", F.posexplode("shape").alias("at", "segment"))), "steps")
    sums = [F.sum(c).alias(c) for c in ("pages", "n")]
    rare = _rare(steps.groupBy("tree", "parent", "node", "segment").agg(*sums), ["tree", "parent"]).select("tree", "node")
    forks = steps.join(rare, ["tree", "node"], "left_semi").groupBy("tree", "leaf").agg(F.min(F.struct("at", "parent")).alias("fork"))
    steps = cut(steps.join(forks, ["tree", "leaf"], "left").select("tree", "leaf", "pages", "n", "b", "at", "segment", "fork"), "forks")
    tail = F.col("at") > F.col("fork.at")
    place = ["tree", "fork", "at"]
    rare = _rare(steps.where(tail).groupBy(*place, "segment").agg(*sums), place).select(*place, "segment", F.lit(True).alias("rare"))
    # The paths' own part keeps clear of the join; only what is below a wildcard has to be looked up.
    below = steps.where(tail).join(rare, [*place, "segment"], "left").withColumn("segment", F.when(F.col("rare"), "{any}").otherwise(F.col("segment"))).select(steps.columns)
    above = steps.where(F.col("fork").isNull() | ~tail).withColumn("segment", F.when(F.col("at") == F.col("fork.at"), "{any}").otherwise(F.col("segment")))
    return cut(_nodes(above.unionByName(below).select("tree", "leaf", "n", "b", "at", "segment")), "templates")


def merged(steps: DataFrame) -> DataFrame:
    """tree, parent, node, n, b: the labelled and blocked pages of each node together with the siblings that are alike."""
    sums = [F.sum(c).alias(c) for c in ("n", "b")]
    share = F.col("b") / F.col("n")
    cell = sum((share >= border).cast("int") for border in BORDERS)
    nodes = cut(steps.groupBy("tree", "parent", "node").agg(*sums).where("n > 0").withColumn("cell", cell), "nodes")
    # A parent has at most CELLS rows from here on.
    cells, order, family = nodes.groupBy("tree", "parent", "cell").agg(*sums), Window.partitionBy("tree", "parent").orderBy("cell"), ["tree", "parent", "pool"]
    n, b = F.lag("n").over(order), F.lag("b").over(order)
    base = (F.col("b") + b) / (F.col("n") + n)
    apart = F.abs(share - b / n) > Z * F.sqrt(base * (1 - base) * (1 / F.col("n") + 1 / n))
    cells = cells.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("pool", F.sum("new").over(order))
    pools = cells.select("tree", "parent", "cell", *[F.sum(c).over(Window.partitionBy(*family)).alias(c) for c in ("n", "b")])
    return nodes.select("tree", "parent", "node", "cell").join(pools, ["tree", "parent", "cell"]).select("tree", "parent", "node", "n", "b")


def purity(leaves: DataFrame) -> DataFrame:
    """tree, leaf, share (smoothed block share), labelled (labelled pages of the tree). leaves: tree, leaf, shape, pages, n, b."""
    steps = generalise(leaves)
    counts = merged(steps).select("tree", "node", "n", "b")
    ways = steps.select("tree", "leaf", "at", "node").join(counts, ["tree", "node"]).groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct("at", "n", "b"))).alias("way"))
    roots = leaves.groupBy("tree").agg(F.sum("n").alias("labelled"), F.sum("b").alias("blocked"))
    # A node without labelled pages leaves its parent's share as it is, so it is in no way.
    root = F.when(F.col("labelled") > 0, F.col("blocked") / F.col("labelled")).otherwise(0.0)
    share = F.coalesce(F.aggregate("way", root, lambda prior, x: (x["b"] + PRIOR * prior) / (x["n"] + PRIOR)), root)
    return leaves.select("tree", "leaf").join(ways, ["tree", "leaf"], "left").join(roots, "tree").select("tree", "leaf", share.alias("share"), "labelled")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, share (null where a rule decides)."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p")).select("page_id", F.coalesce("h", F.lit("")).alias("host"), F.coalesce("p", F.lit("")).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("by_rule", verdict).withColumn("shape", segments(F.col("path")))
    rows = rows.withColumn("leaf", F.sha2(F.array_join("shape", "/"), 256))
    counts = rows.groupBy("host", "leaf").agg(
        F.first("shape").alias("shape"), F.count("*").alias("pages"), F.count("by_rule").cast("double").alias("n"), F.count(F.when(F.col("by_rule") == "block", 1)).cast("double").alias("b")
    )
    counts = cut(counts.withColumn("tree", F.concat(F.lit("="), "host")).drop("host"), "paths")
    # The tree over all hosts has the same paths.
    overall = counts.groupBy("leaf").agg(F.first("shape").alias("shape"), *[F.sum(c).alias(c) for c in ("pages", "n", "b")]).withColumn("tree", F.lit("*"))
    shares = cut(purity(cut(counts.unionByName(overall), "leaves")), "shares")
    every = shares.where("tree = '*'").select("leaf", F.col("share").alias("overall"))
    # A host without labelled pages says nothing of its own; with few it is smoothed towards all hosts.
    weight = F.least("labelled", F.lit(100.0))
    judged = shares.where("tree <> '*'").join(every, "leaf").select(F.expr("substr(tree, 2)").alias("host"), "leaf", ((F.col("share") * weight + PRIOR * F.col("overall")) / (weight + PRIOR)).alias("share"))
    # Pages that a rule decides need no share and aren't shuffled.
    plain = ["page_id", "host", "path", "rule"]
    found = rows.where("by_rule IS NULL").select(*plain, "leaf").join(judged, ["host", "leaf"])
    found = found.select(*plain, F.when(F.col("share") >= BLOCK, "block").otherwise("allow").alias("verdict"), "share")
    return rows.where("by_rule IS NOT NULL").select(*plain, F.col("by_rule").alias("verdict"), F.lit(None).cast("double").alias("share")).unionByName(found)


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).withColumn("share", F.round("share", 6))
