"""Rules of records as violation queries, and records of earlier layouts in today's.

Each rule query returns the rows that break a rule, with the first rule they break; no rows means that all is well.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.sources import store

# Fixed values of the contract.
NEEDS_QUESTION = ("QUESTION_VISIT", "QUESTION_LEAVE", "RETURN", "REVISION_CANDIDATE")
NEEDS_REFERENCES = ("WRITING", *NEEDS_QUESTION)
TIME_FLAGS = ("MISSING_TIMESTAMP", "TIME_UNAVAILABLE", "NO_TIME_REFERENCE")
OUT_OF_SCOPE = ("emotion", "attention_score", "careless", "wrong_reason", "knowledge_difficulty")


def _broken(df: DataFrame, keys: list[str], rule: Column) -> DataFrame:
    return df.select(*keys, rule.alias("rule")).where("rule IS NOT NULL")


def event_violations(events: DataFrame) -> DataFrame:
    """session_id, event_id, rule. events: as detected, with stroke_ref."""
    untimed = F.col("start_time_ms").isNull() | F.col("end_time_ms").isNull()
    refs = F.concat("point_refs", F.array_compact(F.array("stroke_ref")))
    return _broken(
        events,
        ["session_id", "event_id"],
        F.when(F.exists(refs, lambda x: F.coalesce(F.length(x) == 0, F.lit(True))), "EMPTY_REFERENCE")
        .when(F.col("end_time_ms") < F.col("start_time_ms"), "TIME_ORDER")
        .when((F.col("quality_status") == "VALID") & untimed, "VALID_WITHOUT_TIME")
        .when(untimed & ~F.arrays_overlap("quality_flags", F.array(*map(F.lit, TIME_FLAGS))), "UNEXPLAINED_TIME")
        .when(F.col("event_type").isin(*NEEDS_QUESTION) & F.col("question_id").isNull(), "QUESTION_MISSING")
        .when(F.col("event_type").isin(*NEEDS_REFERENCES) & (F.size(refs) == 0), "REFERENCES_MISSING"),
    )


def stroke_violations(strokes: DataFrame) -> DataFrame:
    """session_id, stroke_id, rule."""
    span = F.col("end_time_ms") - F.col("start_time_ms")
    return _broken(strokes, ["session_id", "stroke_id"], F.when(span < 0, "TIME_ORDER").when(F.col("duration_ms") < 0, "NEGATIVE_DURATION").when(F.col("duration_ms") != span, "DURATION"))


def region_violations(regions: DataFrame) -> DataFrame:
    """region_id, rule. regions may have region_type; a rectangle has four corners, and so has any region of the legacy space."""
    kind = F.col("region_type") if "region_type" in regions.columns else F.lit("polygon")
    values = F.flatten(F.transform("polygon", lambda p: F.array(p["x"], p["y"])))
    odd = F.exists(values, lambda v: F.coalesce(F.isnan(v) | v.isin(float("inf"), float("-inf")), F.lit(True)))
    four = (kind == "rectangle") | (F.col("coordinate_space") == "legacy")
    return _broken(
        regions,
        ["region_id"],
        F.when(F.coalesce(F.size("polygon") < 3, F.lit(True)), "TOO_FEW_CORNERS")
        .when(four & (F.size("polygon") != 4), "RECTANGLE_CORNERS")
        .when(odd, "NOT_FINITE")
        .when((F.col("coordinate_space") == "norm") & F.exists(values, lambda v: ~v.between(0, 1)), "OUT_OF_RANGE"),
    )


def out_of_scope(rows: DataFrame, json: str, key: str, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """key, field and path of the fields that no output may have, at any depth of the rows' JSON text; text that isn't JSON raises.

    A level of all texts is unfolded at a time and written (keep), until no object or list is left, so keys are compared as they are
    read, however they are written, and the number of steps is the greatest depth.
    """
    keep = keep or store.keeper(rows.sparkSession, "guard")
    level = rows.where(F.col(json).isNotNull()).select(F.col(key), F.parse_json(F.col(json)).alias("_v"), F.lit(json).alias("path"))
    found = None
    for depth in itertools.count():
        nested = F.schema_of_variant("_v").rlike("^(OBJECT|ARRAY)")
        inner = rows.sparkSession.sql(
            f"SELECT t.`{key}`, e.key AS field, e.value AS _v, concat(t.path, CASE WHEN e.key IS NULL THEN concat('[', e.pos, ']') ELSE concat('.', e.key) END) AS path FROM {{t}} t, LATERAL variant_explode(t._v) e",
            t=level.where(nested),
        )
        inner = keep(inner, f"level-{depth}")
        here = inner.where(F.col("field").isin(*OUT_OF_SCOPE)).select(key, "field", "path")
        found = here if found is None else found.unionByName(here)
        level = inner.drop("field")
        if inner.where(nested).isEmpty():
            return found


def _column(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def legacy_points(rows: DataFrame) -> DataFrame:
    """Point records of the earlier layout (raw_index; coordinates, time and pressure in a struct normalized) as canonical records."""
    order = F.coalesce(_column(rows, "raw_index", "long"), F.lit(0).cast("long"))
    inner = set(rows.schema["normalized"].dataType.names) if "normalized" in rows.columns else set()
    nested = lambda k, kind: F.col(f"normalized.{k}").cast(kind) if k in inner else F.lit(None).cast(kind)
    return rows.select(
        "point_id", "session_id", *[_column(rows, c, "string").alias(c) for c in ("participant_id", "task_segment_id", "device_id", "page_id")],
        F.coalesce(_column(rows, "sequence", "long"), order).alias("sequence"), nested("timestamp_ms", "long").alias("timestamp_ms"),
        nested("x", "double").alias("x_raw"), nested("y", "double").alias("y_raw"), F.lit(None).cast("double").alias("x_norm"), F.lit(None).cast("double").alias("y_norm"),
        nested("pressure", "double").alias("pressure_raw"), F.lit("UNKNOWN").alias("pen_state"), order.alias("source_index"), order.alias("raw_order"),
        F.coalesce(_column(rows, "quality_flags", "array<string>"), F.array().cast("array<string>")).alias("quality_flags"),
    )


def legacy_strokes(rows: DataFrame) -> DataFrame:
    """Stroke records of the earlier layout (start_timestamp_ms, end_timestamp_ms, raw_order) in today's columns."""
    start, end = F.col("start_timestamp_ms").cast("long"), F.col("end_timestamp_ms").cast("long")
    refs = F.coalesce(_column(rows, "raw_order", "array<string>"), F.array().cast("array<string>"))
    return rows.select(
        "stroke_id", "session_id", *[_column(rows, c, "string").alias(c) for c in ("participant_id", "task_segment_id", "page_id")],
        refs.alias("point_refs"), F.coalesce(_column(rows, "processed_order", "array<string>"), refs).alias("processed_order"),
        start.alias("start_time_ms"), end.alias("end_time_ms"), (end - start).alias("duration_ms"), "bbox", F.lit("unavailable").alias("bbox_space"),
        F.coalesce(_column(rows, "quality_flags", "array<string>"), F.array().cast("array<string>")).alias("quality_flags"),
    )


def legacy_events(rows: DataFrame) -> DataFrame:
    """Event records of the earlier layout (occurred_at_ms, source_point_ids, source_stroke_ids) in today's columns.

    An event without a time is degraded and flagged, and a question event without a question has the question UNKNOWN.
    """
    at = F.col("occurred_at_ms").cast("long")
    status = F.coalesce(_column(rows, "quality_status", "string"), F.lit("VALID"))
    flags = F.coalesce(_column(rows, "quality_flags", "array<string>"), F.array().cast("array<string>"))
    question = _column(rows, "question_id", "string")
    refs = lambda c: F.coalesce(_column(rows, c, "array<string>"), F.array().cast("array<string>"))
    return rows.select(
        "event_id", "event_type", "session_id", *[_column(rows, c, "string").alias(c) for c in ("task_segment_id", "participant_id", "page_id")],
        F.when(question.isNull() & F.col("event_type").isin(*NEEDS_QUESTION), "UNKNOWN").otherwise(question).alias("question_id"),
        F.coalesce(_column(rows, "sequence", "long"), F.lit(0).cast("long")).alias("sequence"), at.alias("start_time_ms"), at.alias("end_time_ms"),
        refs("source_point_ids").alias("point_refs"), refs("source_stroke_ids").alias("stroke_refs"),
        F.when(at.isNull() & (status == "VALID"), "DEGRADED").otherwise(status).alias("quality_status"),
        F.array_distinct(F.concat(flags, F.array_compact(F.array(F.when(at.isNull(), "TIME_UNAVAILABLE"))))).alias("quality_flags"),
    )


def legacy_rectangles(rows: DataFrame) -> DataFrame:
    """Rectangles (region_id, page_id, question_id, x, y, width, height, priority) as regions in raw coordinates; a negative side raises."""
    side = lambda c: F.when(F.col(c) < 0, F.raise_error(F.lit("a rectangle's sides can't be negative")).cast("double")).otherwise(F.col(c))
    x2, y2 = F.col("x") + side("width"), F.col("y") + side("height")
    corner = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    x, y = F.col("x"), F.col("y")
    return rows.select(
        "region_id", "page_id", "question_id", F.lit("rectangle").alias("region_type"), F.array(corner(x, y), corner(x2, y), corner(x2, y2), corner(x, y2)).alias("polygon"),
        F.coalesce(_column(rows, "priority", "int"), F.lit(0)).alias("priority"), F.lit("legacy").alias("coordinate_space"),
    )


def legacy_mappings(rows: DataFrame) -> DataFrame:
    """Mapping records with the former names of times and references. Where a record has both names, today's holds."""
    new = {"start_timestamp_ms": "start_time_ms", "end_timestamp_ms": "end_time_ms", "source_point_ids": "point_refs"}
    there = rows.withColumnsRenamed({a: b for a, b in new.items() if a in rows.columns and b not in rows.columns})
    return there.drop(*new)
