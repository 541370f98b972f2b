"""What a dataset was made from, as hashes at every level: its config, each case, all cases, each split, each audit.

A case's hash covers its immutable columns; in which split it is stands in the split's hash alone, so moving a case changes no case. Sets of
cases are hashed as a tree: cases by the hash of their id, in groups of a prefix, so every step is a partial aggregation and no group grows
beyond its prefix's share. Roots don't depend on order or partitions.

Cases: null columns are hashed as nulls; a case that occurs twice counts twice; an empty set has no root, and so no row.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import audits, dataset

#: Columns of a case that its hash leaves out.
MUTABLE = ("split", "case_manifest_hash")
#: Characters of the hashed id that name a group at each level, finest first.
PREFIXES = (6, 3, 0)
_KIND = "level string, name string, hash string, n bigint"


def tagged(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def canonical(columns: list[str]) -> Column:
    """The columns as one JSON object with sorted keys, without blanks, nulls kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def case_hash(cases: DataFrame) -> Column:
    return tagged(canonical([c for c in cases.columns if c not in MUTABLE]))


def with_case_hash(cases: DataFrame) -> DataFrame:
    return cases.withColumn("case_manifest_hash", case_hash(cases))


def root(rows: DataFrame, id: Column, hash: Column, by: list[str] | None = None) -> DataFrame:
    """by, root, n: the root of all rows' hashes, in order of the hash of their ids, of each value of by."""
    by = by or []
    level = rows.select(*by, F.sha2(id, 256).alias("_k"), hash.alias("_h"), F.lit(1).cast("long").alias("n"))
    for length in PREFIXES:
        ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_h"))), lambda x: F.concat(x["_k"], F.lit("="), x["_h"])), "\n")
        level = level.groupBy(*by, F.substring("_k", 1, length).alias("_p")).agg(tagged(ordered).alias("_h"), F.sum("n").alias("n")).withColumnRenamed("_p", "_k")
    return level.select(*by, F.col("_h").alias("root"), "n")


def config_json(config: Mapping) -> str:
    """Canonical JSON of a config; numbers that aren't finite raise."""
    return json.dumps(config, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def _config_row(spark: SparkSession, config: Mapping) -> DataFrame:
    return spark.createDataFrame([("config", "config", "sha256:" + hashlib.sha256(config_json(config).encode()).hexdigest(), 1)], _KIND)


def _split_rows(manifests: DataFrame) -> DataFrame:
    """A split's hash: what it says of itself and the roots of the cases, participants and groups that it lists."""
    lists = ("case_ids", "participant_ids", "group_ids")
    roots = []
    for c in lists:
        listed = manifests.select("split_name", F.explode(c).alias("id"))
        roots.append(root(listed, F.col("id"), F.col("id"), ["split_name"]).select("split_name", F.col("root").alias(f"{c}_root")))
    found = reduce(lambda a, b: a.join(b, "split_name", "left"), roots, manifests.drop(*lists))
    fields = [c for c in found.columns]
    return found.select(F.lit("split").alias("level"), F.col("split_name").alias("name"), tagged(canonical(fields)).alias("hash"), F.col("count").cast("long").alias("n"))


def _audit_rows(results: Mapping[str, DataFrame]) -> list[DataFrame]:
    """An audit's hash is that of its violations; one without violations has the hash of nothing."""
    found = []
    for name, violations in results.items():
        rows = violations.select(canonical(violations.columns).alias("row"))
        counted = rows.agg(F.count("*").alias("n"))
        made = root(rows, F.col("row"), F.sha2("row", 256)).select("root")
        one = counted.withColumn("_one", F.lit(1)).join(made.withColumn("_one", F.lit(1)), "_one", "left")  # a row each
        found.append(one.select(F.lit("audit").alias("level"), F.lit(name).alias("name"), F.coalesce("root", tagged(F.lit(""))).alias("hash"), "n"))
    return found


def state(config: Mapping, cases: DataFrame, manifests: DataFrame, results: Mapping[str, DataFrame]) -> DataFrame:
    """level (config, cases, split, audit), name, hash, n of a dataset as it is. cases: with case_manifest_hash."""
    of_cases = root(cases, F.col("case_id"), F.col("case_manifest_hash")).select(F.lit("cases").alias("level"), F.lit("cases").alias("name"), F.col("root").alias("hash"), "n")
    return reduce(DataFrame.unionByName, [_config_row(cases.sparkSession, config), of_cases, _split_rows(manifests), *_audit_rows(results)])


def standard_audits(config: Mapping, cases: DataFrame, manifests: DataFrame) -> dict[str, DataFrame]:
    """What the leakage audit and the split audit find, as a reload repeats them."""
    fields = [c for c in ("case_id", "participant_id", "session_id", "group_id", "raw_records_hash") if c in cases.columns]
    return {
        "leakage": dataset.leakage(cases, fields),
        "splits": audits.splits(cases, manifests, config["dataset_id"], config["dataset_version"], config["split_seed"]),
    }


def changes(stated: DataFrame, config: Mapping, cases: DataFrame, manifests: DataFrame) -> DataFrame:
    """rule, name of everything in which a dataset differs from its stated lineage.

    CASE_HASH: a case isn't what its own hash says. CASES_ROOT, CONFIG_HASH, SPLIT_HASH, AUDIT_RESULT: a level isn't what was stated;
    LEVEL_ABSENT, LEVEL_UNKNOWN: it is stated only, or there only. CONFIG_IDENTITY: a case names another dataset or version. AUDIT_FAILS:
    an audit that is run again finds something.
    """
    now = state(config, with_case_hash(cases), manifests, standard_audits(config, cases, manifests))
    old = stated.select("level", "name", F.col("hash").alias("_hash"), F.col("n").alias("_n"))
    both = now.join(old, ["level", "name"], "full")
    names = F.create_map(*[F.lit(x) for pair in (("config", "CONFIG_HASH"), ("cases", "CASES_ROOT"), ("split", "SPLIT_HASH"), ("audit", "AUDIT_RESULT")) for x in pair])
    rule = F.when(F.col("hash").isNull(), "LEVEL_ABSENT").when(F.col("_hash").isNull(), "LEVEL_UNKNOWN").when((F.col("hash") != F.col("_hash")) | (F.col("n") != F.col("_n")), names[F.col("level")])
    found = both.select(rule.alias("rule"), "name").where("rule IS NOT NULL")
    fails = now.where("level = 'audit' AND n > 0").select(F.lit("AUDIT_FAILS").alias("rule"), "name")
    wrong = cases.where(~F.col("case_manifest_hash").eqNullSafe(case_hash(cases))).select(F.lit("CASE_HASH").alias("rule"), F.col("case_id").alias("name"))
    other = cases.where(~F.col("dataset_id").eqNullSafe(config["dataset_id"]) | ~F.col("dataset_version").eqNullSafe(config["dataset_version"]))
    return reduce(DataFrame.unionByName, [found, fails, wrong, other.select(F.lit("CONFIG_IDENTITY").alias("rule"), F.col("case_id").alias("name"))])
