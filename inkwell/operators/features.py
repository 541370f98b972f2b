"""Observation episodes and their twelve features, one per stroke, with sequences, missingness and normalisation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.config import FeatureConfig
from inkwell.functions.geometry import complete, extent, overlap
from inkwell.operators.scan import PIECE_ROWS, by_length, quantiles
from inkwell.sources import store

FEATURES = ("duration_s", "path_length_norm", "mean_speed_norm_per_s", "pause_before_s", "pause_inside_s", "bbox_width_norm", "bbox_height_norm", "question_occupancy", "visit_index", "return_count", "previous_ink_iou", "quality_valid")


def episodes(mappings: DataFrame, config: FeatureConfig | None = None, splits: DataFrame | None = None, counted: DataFrame | None = None) -> DataFrame:
    """mappings with the features. A session is a case; visits count per participant and task segment, pauses per case. splits
    (participant_id, split): episodes then have the split of their participant, and those of no known participant are left out.
    counted: what has as many rows of each participant, or more, and is cheaper to read than mappings."""
    c = config or FeatureConfig()
    # Columns, not expressions: Spark sorts anew for each expression, though it be the same.
    by_time = ("_untimed", "_start", "stroke_id")
    case = Window.partitionBy("session_id").orderBy(*by_time)
    before = case.rowsBetween(Window.unboundedPreceding, -1)
    n = F.size("norm_points")
    whole = complete(F.col("norm_points"))
    steps = F.zip_with(F.slice("norm_points", F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice("norm_points", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    path = F.when(whole & (n > 0), F.when(n == 1, 0.0).otherwise(F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)))
    gaps = F.zip_with(F.slice("times", F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice("times", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.greatest(F.lit(0), b - a - c.inside_pause_threshold_ms))
    inside = F.when((n >= 2) & F.forall("times", lambda t: t.isNotNull()), F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x) / 1000.0)
    box = F.when(whole & (n > 0), extent(F.col("norm_points")))
    rows = mappings.withColumns({"path_length_norm": path, "pause_inside_s": inside, "_box": box, "is_mapped": F.col("status") == "MAPPED", "_untimed": F.col("start_time_ms").isNull(), "_start": F.coalesce("start_time_ms", F.lit(0))})
    rows = rows.withColumn("_flags", F.sort_array(F.array_distinct(F.concat("quality_flags", "stroke_flags", "point_flags"))))
    rows = rows.withColumns({"_end": F.last("end_time_ms", ignorenulls=True).over(before), "_index": F.row_number().over(case) - 1})
    # Participants that a task holds stand together, and so their splits come to them.
    known = lambda r: r if splits is None else r.join(splits.select("participant_id", "split"), "participant_id")
    made = lambda r: known(_with_features(r, by_time))
    return by_length(rows, "participant_id", PIECE_ROWS, made, made, mappings if counted is None else counted)


def _with_features(rows: DataFrame, by_time: tuple[str, ...]) -> DataFrame:
    history = Window.partitionBy("participant_id", "task_segment_id", "is_mapped").orderBy("session_id", *by_time)
    question = Window.partitionBy("participant_id", "task_segment_id", "is_mapped", "question_id").orderBy("session_id", *by_time)
    ink = Window.partitionBy("participant_id", "task_segment_id", "is_mapped", "question_id", "page_id").orderBy("session_id", *by_time).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.lag("question_id").over(history)).withColumn("_visit", F.row_number().over(question))
    back = (F.col("_visit") > 1) & F.coalesce(F.col("_before") != F.col("question_id"), F.lit(False))
    rows = rows.withColumn("_return", F.sum(back.cast("long")).over(question)).withColumn("_ink", F.last("_box", ignorenulls=True).over(ink))
    mapped, duration = F.col("is_mapped"), (F.col("end_time_ms") - F.col("start_time_ms")) / 1000.0
    return rows.select(
        F.concat_ws("::", "session_id", "stroke_id").alias("episode_id"), "session_id", "participant_id", "task_segment_id", "stroke_id", "question_id", "status",
        F.col("_index").cast("long").alias("episode_index"),
        duration.alias("duration_s"), "path_length_norm",
        F.when(duration > 0, F.col("path_length_norm") / duration).alias("mean_speed_norm_per_s"),
        F.when(F.col("start_time_ms").isNotNull() & F.col("_end").isNotNull(), F.greatest(F.lit(0.0), (F.col("start_time_ms") - F.col("_end")) / 1000.0)).alias("pause_before_s"),
        "pause_inside_s",
        *[F.when((F.col("bbox_space") == "norm") & F.col("path_length_norm").isNotNull(), F.col(f"bbox.{k}")).alias(f"bbox_{k}_norm") for k in ("width", "height")],
        F.when(mapped, F.col("confidence")).alias("question_occupancy"),
        F.when(mapped, F.col("_visit").cast("double")).alias("visit_index"), F.when(mapped, F.col("_return").cast("double")).alias("return_count"),
        F.when(mapped & F.col("_ink").isNotNull() & F.col("_box").isNotNull(), overlap(F.col("_box"), F.col("_ink"), 0.0, 0.0)).alias("previous_ink_iou"),
        (mapped & (F.size("_flags") == 0)).cast("double").alias("quality_valid"),
        "page_id", "point_refs", "start_time_ms", "end_time_ms", F.col("_flags").alias("quality_flags"),
    )


def missingness(rows: DataFrame, by: str | None = None) -> DataFrame:
    """feature, observed, missing, rate, over all rows or per value of a column."""
    long = rows.select(*([by] if by else []), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in FEATURES])).alias("v"))
    return long.groupBy(*([by] if by else []), F.col("v.feature").alias("feature")).agg(
        F.count("v.value").alias("observed"), F.count(F.when(F.col("v.value").isNull(), 1)).alias("missing"), (F.count(F.when(F.col("v.value").isNull(), 1)) / F.count("*")).alias("rate")
    )


def sequences(rows: DataFrame) -> DataFrame:
    """A row per case: values (nulls as 0) and masks of its episodes in order, and its participant, split and targets, where rows have them."""
    values = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in FEATURES])
    masks = F.array(*[F.col(f).isNotNull().cast("int") for f in FEATURES])
    targets = [F.col("target")] if "target" in rows.columns else []
    known = [c for c in ("participant_id", "split") if c in rows.columns]
    step = F.struct("episode_index", F.col("episode_id").alias("id"), values.alias("values"), masks.alias("mask"), *targets)
    found = rows.groupBy("session_id").agg(F.sort_array(F.collect_list(step)).alias("s"), *[F.first(c).alias(c) for c in known])
    fields = [("id", "episode_ids"), ("values", "values"), ("mask", "feature_mask")] + ([("target", "targets")] if targets else [])
    return found.select("session_id", *known, *[F.col(f"s.{k}").alias(a) for k, a in fields], F.size("s").alias("n"))


def normalizer(rows: DataFrame) -> DataFrame:
    """feature, mean, std (population) of the observed values, and constant: whether std is next to nothing, where it is set to 1.

    It is fitted on the rows whose split is train; the others must not be seen.
    """
    long = rows.where("split = 'train'").select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in FEATURES])).alias("v")).select("v.*")
    stats = long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    flat = F.coalesce(F.col("std") <= 1e-12, F.lit(True))
    return stats.select("feature", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.when(flat, 1.0).otherwise(F.col("std")).alias("std"), flat.alias("constant"))


def normalized(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """episode_id, split, values (z-scores, 0 where unknown) and mask (1 where known) of the features in order: 24 channels."""
    wide = stats.agg(*[F.max(F.when(F.col("feature") == f, F.struct("mean", "std"))).alias(f"_{f}") for f in FEATURES])
    each = lambda c: F.col(c).cast("double")
    z = F.array(*[F.coalesce((each(f) - F.col(f"_{f}.mean")) / F.col(f"_{f}.std"), F.lit(0.0)) for f in FEATURES])
    mask = F.array(*[F.col(f).isNotNull().cast("int") for f in FEATURES])
    return rows.withColumn("_one", F.lit(1)).join(F.broadcast(wide.withColumn("_one", F.lit(1))), "_one").select("episode_id", "split", z.alias("values"), mask.alias("mask"))  # one row of twelve


def length_audit(sequences: DataFrame, receptive_field: int = 7, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """One row on the sequences' lengths: least, mean, median, ninth decile (interpolated), greatest, and how many reach the field."""
    n = F.col("n")
    rows = sequences.select(F.lit(0).alias("_one"), n)
    found = rows.groupBy("_one").agg(
        F.count("*").alias("sequences"), F.min(n).cast("long").alias("least"), F.avg(n).alias("mean"), F.max(n).cast("long").alias("greatest"),
        F.count(F.when(n >= receptive_field, 1)).alias("reaching"),
    )
    inner = quantiles(rows, ("_one",), "n", {"median": 0.5, "p90": 0.9}, keep or store.keeper(sequences.sparkSession, "lengths"))
    return found.join(inner, "_one").select("sequences", "least", "mean", "median", "p90", "greatest", "reaching")
