"""Dataset building blocks: seeds, group splits, leakage and integrity audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.geometry import let

SPLITS, RATIOS = ("train", "validation", "test"), (0.7, 0.15, 0.15)
#: Version of the split rule that every split manifest carries.
SPLIT_VERSION = "inkwell-split-1"


def derive_seed(dataset_seed: int, participant: Column, scenario: Column) -> Column:
    """The first 32 bits of the SHA-256 of seed:participant:scenario."""
    text = F.concat_ws(":", F.lit(str(dataset_seed)), participant.cast("string"), scenario.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def split_sizes(total: Column, ratios=RATIOS) -> Column:
    """Array of the splits' sizes: the floors of their shares, one at least.

    What is too much then comes, one by one, from the split that is furthest above its share (ties: the last name) and keeps one;
    what is left goes as a whole to the split whose share lost most by the floor (ties: the first split). With three splits two steps
    are enough.
    """
    if len(ratios) != len(SPLITS) or any(r <= 0 for r in ratios) or abs(sum(ratios) - 1) > 1e-9:
        raise ValueError("three positive ratios that sum to 1 are needed")
    shares = F.array(*[total * F.lit(float(r)) for r in ratios])

    def add(sizes: Column) -> Column:
        return F.aggregate(sizes, F.lit(0).cast("long"), lambda n, x: n + x)

    def less(sizes: Column) -> Column:
        above = F.transform(sizes, lambda n, i: F.when(n > 1, F.struct((n - F.get(shares, i)).alias("above"), F.get(F.array(*map(F.lit, SPLITS)), i).alias("name"), i.alias("i"))))
        return let(F.array_max(above), lambda top: F.when(add(sizes) > total, F.transform(sizes, lambda n, i: n - (i == top["i"]).cast("long"))).otherwise(sizes))

    def more(sizes: Column) -> Column:
        lost = F.transform(shares, lambda s, i: F.struct((s - F.floor(s)).alias("lost"), (-i).alias("i")))
        return let(F.array_max(lost), lambda top: F.transform(sizes, lambda n, i: n + F.when(i == -top["i"], F.greatest(total - add(sizes), F.lit(0))).otherwise(0)))

    return let(let(let(F.transform(shares, lambda s: F.greatest(F.floor(s), F.lit(1)).cast("long")), less), less), more)


def assign_splits(groups: DataFrame, seed: int, ratios=RATIOS, within: tuple[str, ...] = ()) -> DataFrame:
    """groups (group_id) with place and split: in order of the SHA-256 of seed:group, cut by the ratios. within: columns whose values
    are split each by itself. Fewer than three groups raise when the rows are read.

    The order is global, so places are counted per hash prefix first and a window sees the rows of one prefix only.
    """
    keys = list(within)
    rows = groups.select(*keys, "group_id").distinct().withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), "group_id"), 256)).withColumn("_p", F.coalesce(F.substring("_h", 1, 3), F.lit("")))  # never null, so no row of groups is hashed to find that out
    counts = rows.groupBy(*keys, "_p").agg(F.count("*").alias("_n"))
    # 4096 prefixes at most for each value of within.
    own = Window.partitionBy(*(keys or [F.lit(0)]))
    before = counts.withColumn("_before", F.sum("_n").over(own.orderBy("_p")) - F.col("_n")).withColumn("_total", F.sum("_n").over(own)).drop("_n")
    place = F.row_number().over(Window.partitionBy(*keys, "_p").orderBy("_h", "group_id")) + F.col("_before") - 1
    enough = F.when(F.col("_total") < len(SPLITS), F.raise_error(F.lit("at least three groups are needed")).cast("long")).otherwise(F.col("_total"))
    rows = rows.join(before.withColumn("_sizes", split_sizes(enough, ratios)), [*keys, "_p"]).withColumn("place", place.cast("long"))
    first, second = F.get("_sizes", F.lit(0)), F.get("_sizes", F.lit(1))
    return rows.select(*keys, "group_id", "place", F.when(F.col("place") < first, SPLITS[0]).when(F.col("place") < first + second, SPLITS[1]).otherwise(SPLITS[2]).alias("split"))


def split_manifests(cases: DataFrame, dataset_id: str, dataset_version: str, seed: int) -> DataFrame:
    """A row per split: its rule, its cases, participants and groups, sorted, and how many cases. cases: case_id, participant_id,
    group_id, split."""
    lists = [F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in ("participant_id", "group_id", "case_id")]
    found = cases.groupBy(F.col("split").alias("split_name")).agg(F.count("*").alias("count"), *lists)
    return found.select(F.lit(SPLIT_VERSION).alias("split_version"), F.lit("group_id").alias("group_field"), "split_name", F.lit(dataset_id).alias("dataset_id"), F.lit(dataset_version).alias("dataset_version"), F.lit(seed).cast("long").alias("split_seed"), "participant_ids", "group_ids", "case_ids", "count")


def split_counts(cases: DataFrame) -> DataFrame:
    """split, participants, cases."""
    return cases.groupBy("split").agg(F.count_distinct("participant_id").alias("participants"), F.count("*").alias("cases"))


def scenario_counts(cases: DataFrame, families: dict[str, str]) -> DataFrame:
    """family, scenario_type, cases of every scenario in families (scenario by family); 0 for one without cases."""
    known = cases.sparkSession.createDataFrame(sorted(families.items()), "scenario_type string, family string")
    return known.join(cases.groupBy("scenario_type").agg(F.count("*").alias("n")), "scenario_type", "left").select("family", "scenario_type", F.coalesce("n", F.lit(0)).alias("cases"))


def case_quality(points: DataFrame, strokes: DataFrame, mappings: DataFrame, events: DataFrame) -> DataFrame:
    """session_id, quality_status: DEGRADED if a point or stroke has a flag, a mapping isn't MAPPED or an event isn't VALID."""
    bad = lambda df, c: df.groupBy("session_id").agg(F.bool_or(c).alias("bad"))
    flagged = F.size("quality_flags") > 0
    found = bad(points, flagged).unionByName(bad(strokes, flagged)).unionByName(bad(mappings, F.col("status") != "MAPPED")).unionByName(bad(events, F.col("quality_status") != "VALID"))
    return found.groupBy("session_id").agg(F.when(F.bool_or("bad"), "DEGRADED").otherwise("OK").alias("quality_status"))


def leakage(rows: DataFrame, fields: list[str]) -> DataFrame:
    """field, value, n_splits of the values that stand in more than one split. rows: split and the fields."""
    long = rows.select("split", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("v")).select("split", "v.*")
    return long.where("value IS NOT NULL").groupBy("field", "value").agg(F.count_distinct("split").alias("n_splits")).where("n_splits > 1")


def dangling(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of child without a row of parent: a referential check."""
    return child.join(parent.select(*keys).distinct(), keys, "left_anti")
