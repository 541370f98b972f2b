"""Audits as violation queries: (rule, session_id, id) of everything that is wrong. An audit passes if its query has no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.operators.dataset import SPLIT_VERSION, SPLITS
from inkwell.operators.features import FEATURES

# Fixed values of the contract: features that are shares, and what would tell a model whom it looks at or what the answer is, and so can't
# be a feature.
BOUNDED = ("question_occupancy", "previous_ink_iou")
IDENTIFYING = (
    "case_id", "participant_id", "session_id", "task_segment_id", "scenario_id", "scenario_type", "task_family", "device_id", "split", "episode_id", "stroke_id",
    "truth", "prediction", "target", "event_type", "event_id", "hash", "manifest_hash", "seed", "quality_flags", "page_id", "question_id",
)


def _rows(df: DataFrame, rule: str | Column, id: str | Column, session: str | Column = "session_id") -> DataFrame:
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select((F.lit(rule) if isinstance(rule, str) else rule).alias("rule"), as_column(session).cast("string").alias("session_id"), as_column(id).cast("string").alias("id"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _missing(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    return child.join(parent.select(*keys).distinct(), keys, "left_anti")


def references(points: DataFrame, strokes: DataFrame, mappings: DataFrame, events: DataFrame, cases: DataFrame) -> DataFrame:
    """Repeated ids and references to nothing. A session is a case. A repeated point is known if it or the one before it is flagged."""
    flagged = F.array_contains("quality_flags", "DUPLICATE_POINT")
    before = Window.partitionBy("session_id", "point_id").orderBy("raw_order")
    again = points.withColumn("_before", F.lag(flagged).over(before)).where(F.col("_before").isNotNull() & ~F.col("_before") & ~flagged)
    repeated = lambda df, keys, id, rule: _rows(df.groupBy(*keys).count().where("count > 1"), rule, id)
    of_stroke = strokes.select("session_id", "stroke_id", F.explode("point_refs").alias("point_id"))
    of_event = events.select("session_id", "event_id", F.explode("point_refs").alias("point_id"))
    by_stroke = events.where("stroke_ref IS NOT NULL").select("session_id", "event_id", F.col("stroke_ref").alias("stroke_id"))
    point, stroke = ["session_id", "point_id"], ["session_id", "stroke_id"]
    return _union(
        [
            repeated(cases, ["session_id"], "session_id", "DUPLICATE_CASE"),
            _rows(again, "DUPLICATE_POINT", "point_id"),
            repeated(strokes, stroke, "stroke_id", "DUPLICATE_STROKE"),
            _rows(_missing(of_stroke, points, point), "STROKE_POINT_MISSING", "stroke_id").distinct(),
            _rows(_missing(mappings, strokes, stroke), "MAPPING_STROKE_MISSING", "stroke_id"),
            _rows(_missing(events, points, ["session_id"]), "EVENT_CASE_MISSING", "event_id"),
            _rows(_missing(by_stroke, strokes, stroke), "EVENT_STROKE_MISSING", "event_id").distinct(),
            _rows(_missing(of_event, points, point), "EVENT_POINT_MISSING", "event_id").distinct(),
        ]
    )


def splits(cases: DataFrame, manifests: DataFrame, dataset_id: str, dataset_version: str, seed: int) -> DataFrame:
    """What the split manifests have wrong against the cases (case_id, participant_id, group_id, split)."""
    m = manifests
    none = F.lit(None).cast("string")
    name = F.col("split_name")
    listed = m.select("split_name", F.explode("case_ids").alias("case_id"))
    joined = listed.join(cases, "case_id", "left")
    actual = joined.where("split IS NOT NULL").groupBy("split_name").agg(F.array_sort(F.collect_set("participant_id")).alias("participants"), F.array_sort(F.collect_set("group_id")).alias("groups"))
    labelled = cases.groupBy(F.col("split").alias("split_name")).agg(F.count("*").alias("labelled"))
    compared = m.join(actual, "split_name", "left").join(labelled, "split_name", "left")
    empty = F.array().cast("array<string>")
    known = cases.sparkSession.createDataFrame([(s,) for s in SPLITS], "split_name string")
    rule = lambda df, r, when, id=name: _rows(df.where(when), r, id, none)
    return _union(
        [
            _rows(known.join(m, "split_name", "left_anti"), "SPLIT_ABSENT", "split_name", none),
            rule(m, "SPLIT_UNKNOWN", ~name.isin(*SPLITS)),
            _rows(m.groupBy("split_name").count().where("count > 1"), "SPLIT_REPEATED", "split_name", none),
            rule(m, "DATASET_ID", ~F.col("dataset_id").eqNullSafe(dataset_id)),
            rule(m, "DATASET_VERSION", ~F.col("dataset_version").eqNullSafe(dataset_version)),
            rule(m, "SPLIT_SEED", ~F.col("split_seed").eqNullSafe(seed)),
            rule(m, "SPLIT_VERSION", ~F.col("split_version").eqNullSafe(SPLIT_VERSION)),
            rule(m, "COUNT", F.col("count") != F.size("case_ids")),
            rule(compared, "LABELLED_COUNT", F.col("count") != F.coalesce("labelled", F.lit(0))),
            rule(compared, "PARTICIPANTS", F.array_sort(F.array_distinct("participant_ids")) != F.coalesce("participants", empty)),
            rule(compared, "GROUPS", F.array_sort(F.array_distinct("group_ids")) != F.coalesce("groups", empty)),
            rule(joined, "CASE_UNKNOWN", F.col("split").isNull(), F.col("case_id")),
            rule(joined, "CASE_LABEL", F.col("split") != name, F.col("case_id")),
            _rows(cases.join(listed, "case_id", "left_anti"), "CASE_UNLISTED", "case_id", none),
            _rows(listed.groupBy("case_id").count().where("count > 1"), "CASE_REPEATED", "case_id", none),
        ]
    )


def ranges(rows: DataFrame) -> DataFrame:
    """episode_id, feature, value of features out of their range: shares between 0 and 1, quality 0 or 1, all others from 0 on."""
    long = rows.select("episode_id", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in FEATURES])).alias("v")).select("episode_id", "v.*")
    f, v = F.col("feature"), F.col("value")
    bad = F.when(f.isin(*BOUNDED), ~v.between(0, 1)).when(f == "quality_valid", ~v.isin(0.0, 1.0)).otherwise(v < 0)
    return long.where(v.isNotNull() & bad)


def feature_names(names: list[str]) -> list[tuple[str, str]]:
    """(rule, name) of features that are absent, unknown or identifying."""
    found = [("ABSENT", f) for f in FEATURES if f not in names]
    found += [("UNKNOWN", n) for n in sorted(set(names)) if n not in FEATURES]
    return found + [("IDENTIFYING", n) for n in sorted(set(names)) if n in IDENTIFYING]


def inherited_splits(episodes: DataFrame, sequences: DataFrame, cases: DataFrame) -> DataFrame:
    """Episodes and sequences whose split isn't their case's, cases with several splits, and participants in several. episodes:
    session_id, episode_id, participant_id, split; sequences: session_id, split; cases: session_id, split."""
    own = cases.select("session_id", F.col("split").alias("_case"))
    wrong = lambda df, rule, id: _rows(df.join(own, "session_id", "left").where(~F.col("split").eqNullSafe(F.col("_case"))), rule, id)
    several = episodes.groupBy("session_id").agg(F.count_distinct("split").alias("n")).where("n > 1")
    crossing = episodes.groupBy("participant_id").agg(F.count_distinct("split").alias("n")).where("n > 1")
    return _union(
        [
            wrong(episodes, "EPISODE_SPLIT", "episode_id"),
            wrong(sequences, "SEQUENCE_SPLIT", "session_id"),
            _rows(several, "CASE_SPLITS", "session_id"),
            _rows(crossing, "PARTICIPANT_SPLITS", "participant_id", F.lit(None).cast("string")),
        ]
    )


def alignment(aligned: DataFrame) -> DataFrame:
    """True events that don't stand for one episode."""
    return _rows(aligned.where("alignment_status <> 'ONE_TO_ONE'"), F.col("alignment_status"), "truth_event_id")


def ownership(sequences: DataFrame, episodes: DataFrame) -> DataFrame:
    """What sequences say of episodes that aren't there, that are in another split or of another participant or have other values, and
    episodes that no sequence has or several have. sequences: session_id, participant_id, split, episode_ids, values, feature_mask."""
    steps = sequences.select("session_id", "participant_id", "split", F.explode(F.arrays_zip("episode_ids", "values", "feature_mask")).alias("e"))
    steps = steps.select("session_id", "participant_id", "split", F.col("e.episode_ids").alias("episode_id"), F.col("e.values").alias("values"), F.col("e.feature_mask").alias("mask"))
    values = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in FEATURES])
    masks = F.array(*[F.col(f).isNotNull().cast("int") for f in FEATURES])
    own = episodes.select("episode_id", F.col("session_id").alias("_session"), F.col("participant_id").alias("_participant"), F.col("split").alias("_split"), values.alias("_values"), masks.alias("_mask"))
    both = steps.join(own, "episode_id", "full")
    rule = (
        F.when(F.col("_session").isNull(), "EPISODE_UNKNOWN")
        .when(F.col("session_id").isNull(), "EPISODE_UNOWNED")
        .when(~F.col("split").eqNullSafe(F.col("_split")), "EPISODE_SPLIT")
        .when(~F.col("participant_id").eqNullSafe(F.col("_participant")), "EPISODE_PARTICIPANT")
        .when((F.col("values") != F.col("_values")) | (F.col("mask") != F.col("_mask")), "EPISODE_VALUES")
    )
    twice = steps.groupBy("episode_id").agg(F.count("*").alias("n"), F.min("session_id").alias("session_id")).where("n > 1")
    return _union([_rows(both.where(rule.isNotNull()), rule, "episode_id", F.coalesce("session_id", "_session")), _rows(twice, "EPISODE_REPEATED", "episode_id")])


def inputs(rows: DataFrame) -> DataFrame:
    """What a learner's rows (episode_id, split, features) have wrong: splits without rows, ids in all splits, values that aren't finite."""
    none = F.lit(None).cast("string")
    known = rows.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    spread = rows.groupBy("episode_id").agg(F.count_distinct("split").alias("n")).where(F.col("n") == len(SPLITS))
    odd = F.exists(F.array(*[F.col(f).cast("double") for f in FEATURES]), lambda v: F.coalesce(F.isnan(v) | v.isin(float("inf"), float("-inf")), F.lit(False)))
    return _union([_rows(known.join(rows, "split", "left_anti"), "SPLIT_EMPTY", "split", none), _rows(spread, "SPLIT_OVERLAP", "episode_id", none), _rows(rows.where(odd), "NOT_FINITE", "episode_id", none)])


def summary(results: dict[str, DataFrame]) -> DataFrame:
    """audit, status (PASS or FAIL), violations, rules (rule=count, sorted): a row per audit. results: violation queries with a rule."""
    rows = []
    for name, found in results.items():
        rule = F.col("rule") if "rule" in found.columns else F.lit(name)
        counts = found.select(rule.alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))
        rules = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rule", "n"))), lambda x: F.concat_ws("=", x["rule"], x["n"].cast("string"))), ",")
        total = F.coalesce(F.sum("n"), F.lit(0))
        rows.append(counts.agg(total.alias("violations"), rules.alias("rules")).select(F.lit(name).alias("audit"), F.when(F.col("violations") > 0, "FAIL").otherwise("PASS").alias("status"), "violations", "rules"))
    return _union(rows)
