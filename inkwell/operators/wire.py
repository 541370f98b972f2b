"""Wire format of events: projection, provenance, rules of events and batches, export.

Values of the wire contract that other systems read are fixed: the version of a batch, the event types, the qualities, the names
of the provenance's fields and the form of its hash.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.operators.scan import longer

#: Points and strokes of a session at most that stand in lists beside its events.
LISTED = 512
# Fixed values of the contract.
BATCH_VERSION = "r1-event-batch-v0.1"
EVENT_TYPES = ("WRITING", "QUESTION_VISIT", "QUESTION_LEAVE", "RETURN", "REVISION_CANDIDATE", "PAGE_CHANGE", "PROCESS_END", "UNKNOWN")
QUALITIES = ("VALID", "DEGRADED", "INVALID")
PROVENANCE = ("dataset_type", "generator_version", "seed", "scenario_id", "ground_truth_source", "manifest_hash")
COLUMNS = (
    "event_id", "event_type", "session_id", "task_segment_id", "participant_id", "question_id", "start_time_ms", "end_time_ms",
    "point_refs", "stroke_refs", "quality_status", "algorithm_version", "provenance",
)
MOVING = ("latest", "current")
SIMULATED = "sim_"


def concrete(version: str | None) -> str:
    """The version, if it names one; a moving name raises."""
    if not version or version.strip().lower() in MOVING:
        raise ValueError(f"a concrete version is needed, not {version!r}")
    return version


def checked_provenance(value: dict | None) -> dict:
    """The provenance without nulls. Other fields than the contract's raise, and so does a synthetic one that isn't whole."""
    found = {k: v for k, v in (value or {}).items() if v is not None}
    if others := sorted(set(found) - set(PROVENANCE)):
        raise ValueError(f"fields that provenance doesn't have: {others}")
    for k, v in found.items():
        if not isinstance(v, int if k == "seed" else str) or isinstance(v, bool):
            raise ValueError(f"provenance field {k} has the wrong type")
    if found.get("dataset_type") == "synthetic":
        if missing := sorted(set(PROVENANCE) - set(found)):
            raise ValueError(f"synthetic provenance lacks {missing}")
        if not re.fullmatch(r"sha256:[0-9a-f]{64}", found["manifest_hash"]):
            raise ValueError("the manifest hash of synthetic provenance must be a SHA-256")
    return found


def wire_events(events: DataFrame, provenance: dict | None = None) -> DataFrame:
    """The thirteen columns of the contract; a question that is not known is UNKNOWN. provenance is JSON text, of all events alike."""
    known = checked_provenance(provenance)
    text = F.to_json(F.struct(*[F.lit(known[k]).alias(k) for k in PROVENANCE if k in known])) if known else F.lit("{}")
    rows = events.withColumns({"question_id": F.coalesce("question_id", F.lit("UNKNOWN")), "stroke_refs": F.array("stroke_ref"), "provenance": text})
    return rows.select(*COLUMNS)


def _moving(version: Column) -> Column:
    return F.coalesce(F.lower(F.trim(version)).isin(*MOVING) | (F.length(version) == 0), F.lit(True))


def violations(wired: DataFrame) -> DataFrame:
    """event_id and the first rule that the event breaks, for those that break one."""
    empty = lambda c: F.coalesce(F.length(c) == 0, F.lit(True))
    hollow = lambda c: F.exists(c, lambda x: F.coalesce(F.length(x) == 0, F.lit(True)))
    real = lambda c: F.coalesce(~F.col(c).startswith(SIMULATED), F.lit(True))
    synthetic = F.get_json_object("provenance", "$.dataset_type") == "synthetic"
    rule = (
        F.when(empty("event_id") | empty("session_id") | empty("question_id"), "EMPTY_ID")
        .when(~F.coalesce(F.col("event_type").isin(*EVENT_TYPES), F.lit(False)), "EVENT_TYPE")
        .when(~F.coalesce(F.col("quality_status").isin(*QUALITIES), F.lit(False)), "QUALITY_STATUS")
        .when(hollow("point_refs") | hollow("stroke_refs"), "EMPTY_REFERENCE")
        .when(F.col("end_time_ms") < F.col("start_time_ms"), "TIME_ORDER")
        .when((F.col("quality_status") == "VALID") & (F.col("start_time_ms").isNull() | F.col("end_time_ms").isNull()), "VALID_WITHOUT_TIME")
        .when(_moving(F.col("algorithm_version")), "MOVING_VERSION")
        .when(synthetic & (real("session_id") | real("participant_id") | (F.col("task_segment_id").isNotNull() & real("task_segment_id"))), "SYNTHETIC_IDENTITY")
    )
    return wired.select("event_id", rule.alias("rule")).where("rule IS NOT NULL")


def unresolved(wired: DataFrame, points: DataFrame, strokes: DataFrame) -> DataFrame:
    """session_id, event_id, and the point and stroke ids that the session doesn't have. An event of a session of LISTED ids at most is
    compared with a list of these, others are joined by id."""
    several = longer(points.select("session_id").unionByName(strokes.select("session_id")), "session_id", LISTED)
    if several.isEmpty():
        return _listed_lost(wired, points, strokes)
    rest = [df.join(several, "session_id", "left_semi") for df in (wired, points, strokes)]
    return _listed_lost(*[df.join(several, "session_id", "left_anti") for df in (wired, points, strokes)]).unionByName(_joined_lost(*rest))


def _listed_lost(wired: DataFrame, points: DataFrame, strokes: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    rows = wired.select("session_id", "event_id", "point_refs", "stroke_refs")
    for ids, id in ((points, "point_id"), (strokes, "stroke_id")):
        rows = rows.join(ids.groupBy("session_id").agg(F.collect_list(id).alias(f"_{id}s")), "session_id", "left")
    lost = {n: F.array_sort(F.array_except(F.coalesce(F.array_compact(refs), none), F.coalesce(ids, none))) for n, refs, ids in (("missing_points", "point_refs", "_point_ids"), ("missing_strokes", "stroke_refs", "_stroke_ids"))}
    null = lambda c: F.coalesce(F.size(F.array_compact(c)) < F.size(c), F.lit(False))
    found = rows.select("session_id", "event_id", *[v.alias(n) for n, v in lost.items()], (null("point_refs") | null("stroke_refs")).alias("_null"))
    return found.where((F.size("missing_points") > 0) | (F.size("missing_strokes") > 0) | F.col("_null")).drop("_null")


def _joined_lost(wired: DataFrame, points: DataFrame, strokes: DataFrame) -> DataFrame:
    def missing(refs: str, ids: DataFrame, id: str, name: str) -> DataFrame:
        named = wired.select("session_id", "event_id", F.explode(refs).alias(id))
        return named.join(ids.select("session_id", id).distinct(), ["session_id", id], "left_anti").groupBy("session_id", "event_id").agg(F.sort_array(F.collect_set(id)).alias(name))

    none = F.array().cast("array<string>")
    found = missing("point_refs", points, "point_id", "missing_points").join(missing("stroke_refs", strokes, "stroke_id", "missing_strokes"), ["session_id", "event_id"], "full")
    return found.select("session_id", "event_id", *[F.coalesce(c, none).alias(c) for c in ("missing_points", "missing_strokes")])


def batches(wired: DataFrame, dataset_version: str, data_version: str | None = None) -> DataFrame:
    """A batch per session and task segment, with its events by id. data_version: of the result that the events come from; another
    dataset_version than that raises. one_version says whether all its events share an algorithm version that isn't a moving one."""
    concrete(dataset_version)
    if data_version is not None and data_version != dataset_version:
        raise ValueError("the dataset's version must be that of the result")
    moving = F.max(_moving(F.col("algorithm_version")).cast("int")) == 1
    found = wired.groupBy("session_id", "task_segment_id").agg(
        F.count("*").alias("n_events"),
        ((F.min("algorithm_version") == F.max("algorithm_version")) & ~moving).alias("one_version"),
        F.min("algorithm_version").alias("algorithm_version"),
        F.sort_array(F.collect_list(F.struct(*COLUMNS))).alias("events"),
    )
    return found.select(
        F.lit(BATCH_VERSION).alias("contract_version"), F.concat_ws(":", "session_id", F.coalesce("task_segment_id", F.lit("-"))).alias("batch_id"), "session_id", "task_segment_id",
        F.lit(dataset_version).alias("dataset_version"), "algorithm_version", "n_events", "one_version", "events",
    )


def export(wired: DataFrame, points: DataFrame, strokes: DataFrame, dataset_version: str, strict: bool = True) -> DataFrame:
    """Batches of a whole result with status and unresolved: how many of a batch's events name points or strokes that aren't there. Such a
    batch is REFUSED and hands on no events; if strict, it raises when it is read. Others are EXPORTED."""
    lost = unresolved(wired, points, strokes).select("session_id", "event_id").distinct().withColumn("_lost", F.lit(1).cast("long"))
    segment = F.coalesce("task_segment_id", F.lit("-"))
    counts = wired.join(lost, ["session_id", "event_id"], "left").groupBy("session_id", segment.alias("_segment")).agg(F.coalesce(F.sum("_lost"), F.lit(0)).alias("unresolved"))
    made = batches(wired, dataset_version).withColumn("_segment", segment).join(counts, ["session_id", "_segment"])
    refused = F.col("unresolved") > 0
    status = F.when(refused, F.raise_error(F.concat(F.lit("references of a batch can't be resolved: "), "batch_id")).cast("string") if strict else F.lit("REFUSED")).otherwise("EXPORTED")
    return made.withColumn("status", status).withColumn("events", F.when(~refused, F.col("events"))).drop("_segment")


def out_of_context(wired: DataFrame, session_id: str, task_segment_id: str | None) -> DataFrame:
    """Events that don't belong to the result of this session and segment."""
    return wired.where(~(F.col("session_id").eqNullSafe(F.lit(session_id)) & F.col("task_segment_id").eqNullSafe(F.lit(task_segment_id).cast("string"))))
