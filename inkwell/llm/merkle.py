"""A Merkle manifest of a dataset: leaves per row, a tree per group, a tree over the groups' roots, and a proof for every row.

1. A row's leaf is the hash of its encoded columns. Leaves are written, so a text is read and hashed once.
2. Leaves are ranked in their group by range partitions: places in a partition, and counts of the partitions before. No task has to
   hold a group.
3. A level is a window partitioned by group and parent index. Its ordered full-frame collect_list is the parent's preimage and has the
   siblings; the first node of each run carries the parent on to the next level. Groups stop at their own last node.
4. The groups' roots are the leaves of a tree of their own, by the same levels.
5. Proofs go down again, a join a level on group and parent index, so the rows halve from level to level and none is sent more than
   about twice.

A digest is hashed as lowercase hex text and kept as bytes. A step of a proof has the run's digests before and after the node's own.

Cases: a null column is encoded as ``-``, an empty text as ``0:``; a null group is a group of its own, before all others; rows of one
key, or of none (they come first), are ordered by their leaf, so repeated rows have a leaf each with the same digest; a group of one row
has its leaf as root; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import cut, table

#: Consecutive nodes under one parent.
ARITY = 2
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of proofs that are joined before they are written.
LEVELS_A_CUT = 4
_STEPS = "array<struct<before: binary, after: binary>>"


def digest(text: Column) -> Column:
    """SHA-256 as bytes."""
    return F.unhex(F.sha2(text, 256))


def as_text(hash_: Column) -> Column:
    return F.lower(F.hex(hash_))


def encoded(value: Column) -> Column:
    """The value's UTF-8 byte count, a colon and the value; a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns) -> Column:
    """The digest of encoded columns in order."""
    return digest(F.concat(*[encoded(c) for c in columns]))


def group_key(group: Column) -> Column:
    """A text that sorts null first and others bytewise, and is never null."""
    return F.coalesce(F.concat(F.lit("v"), group.cast("string")), F.lit("n"))


def ranked(rows: DataFrame) -> DataFrame:
    """rows with i, the place from 0 on in the group by key and leaf, and n, the group's size. rows: g, key, leaf and others."""
    order = ("g", F.col("key").asc_nulls_first(), "leaf")
    # The last key only spreads rows that are alike in all others.
    placed = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order, "_row").sortWithinPartitions(*order, "_row").drop("_row")
    at = F.col("_at")
    placed = placed.withColumn("_at", F.monotonically_increasing_id()).withColumns({"_part": F.shiftright(at, 33), "_place": at.bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at")
    placed = cut(placed, "ranked")
    runs = placed.groupBy("g", "_part").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    own = Window.partitionBy("g").orderBy("_part")  # a row for each partition that has some of the group
    runs = runs.withColumns({"_before": F.sum("_n").over(own) - F.col("_n"), "n": F.sum("_n").over(Window.partitionBy("g"))}).drop("_n")
    return placed.join(runs, ["g", "_part"]).withColumn("i", F.col("_place") - F.col("_first") + F.col("_before")).drop("_part", "_place", "_first", "_before")


def grow(nodes: DataFrame, what: str, arity: int = ARITY) -> tuple[list[DataFrame], list[DataFrame]]:
    """The written levels of all groups' trees, and for each level the roots of the groups that end there.

    nodes: g, i (from 0 on, without gaps), n (the group's nodes) and h, and others that only the first level keeps. A level has, for the
    groups of several nodes, also p (the parent's place), before and after (the siblings' digests) and parent (its digest).
    """
    levels, roots = [], []
    run = Window.partitionBy("g", "p").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        roots.append(nodes.where("n = 1").select("g", "h"))
        if most <= 1:
            return levels, roots
        place = (F.col("i") % arity).cast("int")
        # Digests are of one length, so they are concatenated as one value, and a node's own is cut out by its place.
        made = nodes.where("n > 1").withColumn("p", F.expr(f"i div {arity}")).withColumn("_run", F.collect_list("h").over(run))
        joined = lambda part: F.unhex(F.array_join(F.transform(part, F.hex), ""))
        made = made.withColumns(
            {
                "before": joined(F.slice("_run", F.lit(1), place)), "after": joined(F.slice("_run", place + 2, F.lit(arity))),
                "parent": digest(F.array_join(F.transform("_run", as_text), "")),
            }
        ).drop("_run")
        level = cut(made, f"{what}-{len(levels)}")
        levels.append(level)
        nodes = level.where(F.col("i") % arity == 0).select("g", F.col("p").alias("i"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"), F.col("parent").alias("h"))
        most = -(-most // arity)


def descend(levels: list[DataFrame], roots: list[DataFrame], known: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """g, i, h, subroot, steps (from the node up) and keep of the first level's nodes that aren't roots. known: g, subroot, steps of roots."""
    above = None
    for k in range(len(levels) - 1, -1, -1):
        ended = roots[k + 1].select("g").join(known, "g").select("g", F.lit(0).cast("long").alias("p"), "subroot", "steps")
        above = ended if above is None else ended.unionByName(above.select("g", F.col("i").alias("p"), "subroot", "steps"))
        step = F.array(F.struct("before", "after")).cast(_STEPS)
        above = levels[k].join(above, ["g", "p"]).select("g", "i", "h", "subroot", F.concat(step, "steps").alias("steps"), *(keep if k == 0 else ()))
        if k and (len(levels) - k) % LEVELS_A_CUT == 0:
            above = cut(above, "proofs")
    return above


def fold(leaf_: Column, steps: Column) -> Column:
    """The root (hex) that a leaf (bytes) and its proof give."""
    return F.aggregate(steps, as_text(leaf_), lambda acc, s: F.sha2(F.concat(as_text(s["before"]), acc, as_text(s["after"])), 256))


def proof_digest(steps: Column) -> Column:
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(as_text(s["before"]), as_text(s["after"]))), ""), 256)


def manifest(rows: DataFrame, arity: int = ARITY) -> DataFrame:
    """rows (g, key, leaf and others) with subroot and root (bytes) and steps: the proof from the leaf up to the root."""
    others = tuple(c for c in rows.columns if c not in ("g", "leaf"))
    placed = cut(ranked(rows), "placed").withColumnRenamed("leaf", "h")
    levels, roots = grow(placed, "level", arity)
    subroots = roots[0]
    for r in roots[1:]:
        subroots = subroots.unionByName(r)
    top = cut(ranked(subroots.select(F.lit("").alias("g"), F.col("g").alias("key"), F.col("h").alias("leaf"))), "subroots").withColumnRenamed("leaf", "h")
    upper, ends = grow(top, "upper", arity)
    root = ends[-1].first()
    whole = F.lit(bytes(root["h"]) if root else None).cast("binary")
    none = F.array().cast(_STEPS)
    if upper:
        start = top.select("g").distinct().select("g", F.lit(None).cast("binary").alias("subroot"), none.alias("steps"))
        known = descend(upper, ends, start, ("key",)).select(F.col("key").alias("g"), F.col("h").alias("subroot"), "steps")
    else:
        known = top.select(F.col("key").alias("g"), F.col("h").alias("subroot"), none.alias("steps"))
    known = cut(known, "known")
    found = placed.where("n = 1").join(known, "g").select("g", "h", "subroot", "steps", *others)
    if levels:
        found = found.unionByName(descend(levels, roots, known, others).select("g", "h", "subroot", "steps", *others))
    return found.withColumnRenamed("h", "leaf").withColumn("root", whole)


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    """Every document's leaf, its group's root, the root, its proof's digest, and the root that it folds to after tampering with n_chars."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    changed = leaf([F.col(c).cast("decimal(20,0)") + 1 if c == "n_chars" else F.col(c) for c in COLUMNS])
    rows = docs.select(group_key(F.col("lang")).alias("g"), F.col("doc_id").alias("key"), leaf(map(F.col, COLUMNS)).alias("leaf"), F.when(tampered, changed).alias("tampered"))
    found = manifest(cut(rows, "leaves"))
    root, folded = as_text(F.col("root")), fold(F.coalesce("tampered", "leaf"), F.col("steps"))
    found = found.select(
        F.col("key").alias("doc_id"), as_text(F.col("leaf")).alias("leaf"), as_text(F.col("subroot")).alias("subroot"), root.alias("root"),
        proof_digest(F.col("steps")).alias("proof_sha256"), folded.alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
