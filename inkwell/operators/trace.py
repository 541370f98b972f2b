"""Evidence of events, run status, and manual review of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.operators.scan import longer

#: Points and strokes of a session at most that stand in lists beside its events.
LISTED = 512


def traces(events: DataFrame, strokes: DataFrame, points: DataFrame) -> DataFrame:
    """A row per event with what its evidence lacks; error is null where the trace is whole.

    Ids must be unique for anything to be resolved: one repeated id fails all events of its session. Then come unknown strokes, unknown
    points, and points of the stroke that the event doesn't name. An event of a session of LISTED points and strokes at most is compared with
    lists of these, others are joined by id.
    """
    several = longer(points.select("session_id").unionByName(strokes.select("session_id")), "session_id", LISTED)
    if several.isEmpty():
        return _listed_traces(events, strokes, points)
    inside = [df.join(several, "session_id", "left_anti") for df in (events, strokes, points)]
    return _listed_traces(*inside).unionByName(_joined_traces(*[df.join(several, "session_id", "left_semi") for df in (events, strokes, points)]))


def _error(double_stroke: Column, double_point: Column, own: Column, missing: Column) -> Column:
    return (
        F.when(double_stroke, "DUPLICATE_STROKE_ID").when(double_point, "DUPLICATE_POINT_ID").when(own.isNull(), "MISSING_STROKE").when(missing > 0, "MISSING_POINT")
        .when(F.size(F.array_except(own, "point_refs")) > 0, "UNCOVERED_STROKE_POINT").alias("error")
    )


def _listed_traces(events: DataFrame, strokes: DataFrame, points: DataFrame) -> DataFrame:
    there = points.groupBy("session_id").agg(F.collect_list("point_id").alias("_points"))
    there = there.select("session_id", F.array_distinct("_points").alias("_points"), F.size("_points").alias("_n"))
    made = strokes.groupBy("session_id").agg(F.collect_list(F.struct("stroke_id", F.col("point_refs").alias("own"))).alias("_strokes"))
    made = made.withColumn("_double", F.size(F.array_distinct(F.transform("_strokes", lambda s: s["stroke_id"]))) < F.size("_strokes"))
    rows = events.select("session_id", "event_id", "event_type", "stroke_ref", "point_refs").join(there, "session_id", "left").join(made, "session_id", "left")
    named = F.array_compact(F.array_distinct("point_refs"))
    lost = F.coalesce(F.size(F.array_except(named, F.coalesce("_points", F.array().cast("array<string>")))), F.lit(0))
    rows = rows.withColumns({"_named": F.coalesce(F.size(named), F.lit(0)), "_lost": lost, "own": F.get(F.filter("_strokes", lambda s: s["stroke_id"] == F.col("stroke_ref")), F.lit(0))["own"]})
    error = _error(F.col("_double"), F.size("_points") < F.col("_n"), F.col("own"), F.col("_lost"))
    return rows.select("session_id", "event_id", "event_type", "stroke_ref", (F.col("_named") - F.col("_lost")).cast("long").alias("n_points"), error)


def _joined_traces(events: DataFrame, strokes: DataFrame, points: DataFrame) -> DataFrame:
    known = points.groupBy("session_id", "point_id").agg(F.count("*").alias("n"))
    double_points = known.where("n > 1").select("session_id").distinct().withColumn("double_point", F.lit(True))
    double_strokes = strokes.groupBy("session_id", "stroke_id").count().where("count > 1").select("session_id").distinct().withColumn("double_stroke", F.lit(True))
    refs = events.select("session_id", "event_id", F.explode_outer(F.array_distinct("point_refs")).alias("point_id"))
    found = refs.join(known, ["session_id", "point_id"], "left").groupBy("session_id", "event_id").agg(
        F.count(F.when(F.col("point_id").isNotNull() & F.col("n").isNull(), 1)).alias("missing_points"), F.count("n").alias("n_points")
    )
    own = strokes.select("session_id", F.col("stroke_id").alias("stroke_ref"), F.col("point_refs").alias("own")).dropDuplicates(["session_id", "stroke_ref"])
    rows = events.select("session_id", "event_id", "event_type", "stroke_ref", "point_refs").join(own, ["session_id", "stroke_ref"], "left").join(found, ["session_id", "event_id"], "left")
    rows = rows.join(double_points, "session_id", "left").join(double_strokes, "session_id", "left")
    error = _error(F.col("double_stroke"), F.col("double_point"), F.col("own"), F.col("missing_points"))
    return rows.select("session_id", "event_id", "event_type", "stroke_ref", "n_points", error)


def run_status(points: DataFrame, strokes: DataFrame, mappings: DataFrame, events: DataFrame, traced: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """A row per session: INVALID without any point, OK without any flag, else DEGRADED; and the flags in order of first sight.

    Sight goes over points, strokes, mappings and events, each in its order, then over the mappings' statuses, unknown events and
    trace errors. sessions: session_id of all sessions asked for, where some may have no points.
    """

    def flag(df, n, place, flags):
        return df.select("session_id", F.lit(n).alias("n"), F.col(place).cast("long").alias("place"), F.posexplode(flags).alias("k", "flag"))

    one = lambda c: F.array(c)
    flags = (
        flag(points, 0, "raw_order", F.col("quality_flags"))
        .unionByName(flag(strokes, 1, "stroke_index", F.col("quality_flags")))
        .unionByName(flag(mappings, 2, "stroke_index", F.col("quality_flags")))
        .unionByName(flag(events, 3, "sequence", F.col("quality_flags")))
        .unionByName(flag(mappings.where("status <> 'MAPPED'"), 4, "stroke_index", one(F.concat(F.lit("MAPPING_"), F.col("status")))))
        .unionByName(flag(events.where("event_type = 'UNKNOWN'"), 5, "sequence", one(F.lit("UNKNOWN_EVENT"))))
        .unionByName(traced.where("error IS NOT NULL").select("session_id", F.lit(6).alias("n"), F.lit(0).cast("long").alias("place"), F.lit(0).alias("k"), F.lit("TRACE_ERROR").alias("flag")))
    )
    first = flags.groupBy("session_id", "flag").agg(F.min(F.struct("n", "place", "k")).alias("at")).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("at", "flag"))).alias("f"))
    seen = points.select("session_id").distinct().withColumn("any", F.lit(True))
    rows = (sessions.select("session_id").distinct().join(seen, "session_id", "left") if sessions is not None else seen).join(first, "session_id", "left")
    status = F.when(F.col("any").isNull(), "INVALID").when(F.col("f").isNull(), "OK").otherwise("DEGRADED")
    found = F.when(F.col("any").isNull(), F.array(F.lit("EMPTY_INPUT"))).otherwise(F.transform(F.coalesce("f", F.array()), lambda x: x["flag"]))
    return rows.select("session_id", status.alias("quality_status"), found.alias("quality_flags"))


def review_template(events: DataFrame, truth: DataFrame) -> DataFrame:
    """Events beside the truth of the same place in their session, to be labelled. truth: session_id, sequence, event_type."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("sequence"))
    t = truth.select("session_id", place.alias("_n"), F.col("event_type").alias("expected_event_type"))
    rows = events.select("session_id", "event_id", F.col("event_type").alias("predicted_event_type"), place.alias("_n")).join(t, ["session_id", "_n"], "left")
    return rows.select("session_id", "event_id", "predicted_event_type", "expected_event_type", F.lit("UNCERTAIN").alias("label"))


def apply_labels(reviews: DataFrame, labels: DataFrame) -> DataFrame:
    """reviews with labels (event_id, label: YES, NO or UNCERTAIN) put in. Another label, or one of an event that isn't under review,
    raises when the rows are read."""
    checked = F.when(F.col("label").isin("YES", "NO", "UNCERTAIN"), F.col("label")).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce("label", F.lit("null")))))
    new = labels.select("event_id", checked.alias("_new"))
    rows = reviews.withColumn("_known", F.lit(True)).join(new, "event_id", "full")
    known = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("no event under review: "), F.col("event_id"))).cast("string")).otherwise(F.coalesce("_new", "label"))
    return rows.withColumn("label", known).select(reviews.columns)


def review_summary(reviews: DataFrame) -> DataFrame:
    return reviews.agg(F.count("*").alias("total"), *[F.count(F.when(F.col("label") == x, 1)).alias(x.lower()) for x in ("YES", "NO", "UNCERTAIN")])
