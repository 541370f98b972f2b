"""Process events from stroke mappings: visits, leaves, returns, revisions, page changes, writing, the end.

What happens at a mapping depends on the mapping before it, on whether its question was seen before and on earlier ink in the same
place, so scans per participant and task segment say it all; each mapping then yields an array of events that is exploded. Sessions of
more than SHORT mappings are scanned in pieces, and their earlier ink is looked up in a grid, so neither a session nor a question has to fit
a task; the others stand together after one shuffle, and each mapping is compared with all earlier ink of its question.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.config import EventConfig
from inkwell.functions.geometry import named, overlap
from inkwell.operators.ink import touched
from inkwell.operators.mapping import ink_box, writing_evidence
from inkwell.operators.scan import PIECE_ROWS, by_counts, by_length, scan, whole

#: Version of the event rules that every event carries.
VERSION = "inkwell-event-1"
NO_PARTICIPANT, NO_SEGMENT = "__unknown_participant__", "__unknown_task_segment__"


def known_page(c):
    return F.coalesce(~F.upper(F.trim(c)).isin("UNKNOWN", "PAGE_UNKNOWN", "PAGE-UNKNOWN"), F.lit(False))


#: What a group of mappings in one order is, and the order.
GROUP, BY_TIME = ("session_id", "participant_bucket", "segment_bucket"), ("_untimed", "_start", "stroke_id")
#: Mappings that begin in the same so many milliseconds are in one piece of a scan, and those without a time by so many first characters.
BUCKET_MS, PREFIX = 60_000, 12
#: Mappings of a session at most whose ink is compared with all earlier ink.
SHORT = 512


def _keep(df: DataFrame, name: str) -> DataFrame:
    return df


def _prepared(mappings: DataFrame) -> DataFrame:
    """mappings with their groups, order, and what of them is looked at."""
    return (
        mappings.withColumn("participant_bucket", F.coalesce("participant_id", F.lit(NO_PARTICIPANT)))
        .withColumn("segment_bucket", F.coalesce("task_segment_id", F.lit(NO_SEGMENT)))
        .withColumn("is_mapped", (F.col("status") == "MAPPED") & F.col("question_id").isNotNull())
        .withColumn("writes", F.coalesce(writing_evidence(), F.lit(False)))
        .withColumn("ink", ink_box())
        .withColumn("page_known", known_page(F.col("page_id")))
        .withColumns({"_untimed": F.col("start_time_ms").isNull(), "_start": F.coalesce("start_time_ms", F.lit(0))})
        .drop("norm_points", "raw_points", "times", "stroke_flags", "point_flags", "bbox", "bbox_space")
    )


CARRIED = ("stroke_id", "question_id", "page_id", "start_time_ms", "end_time_ms", "point_refs", "quality_flags", "status", "participant_id", "task_segment_id")


def _looks_back() -> dict:
    return {"lag": {"_active": F.when(F.col("is_mapped"), F.struct(*CARRIED))}, "last": {"_page": F.when(F.col("page_known"), F.col("page_id"))}, "ends": "_last"}


def _traced() -> Column:
    """Whether a mapping's ink is compared."""
    return F.col("is_mapped") & F.col("ink").isNotNull() & F.col("page_id").isNotNull() & ~((F.col("ink.space") == "raw") & (F.col("ink.domain") == "unknown"))


def _with_states(found: DataFrame, c: EventConfig) -> DataFrame:
    return found.withColumns(
        {
            "_seen": F.coalesce(F.col("is_mapped") & (F.struct(*BY_TIME) > F.col("_first")), F.lit(False)),
            "page_changed": F.coalesce(F.col("page_known") & (F.col("page_id") != F.col("_page")), F.lit(False)),
            "overlaps": F.coalesce("overlaps", F.lit(False)),
            "paused": F.coalesce(F.col("start_time_ms") - F.col("_active.end_time_ms") >= c.revision_pause_threshold_ms, F.lit(False)),
        }
    )


def short_states(rows: DataFrame, config: EventConfig) -> DataFrame:
    """states of sessions that stand together and of which a question's ink is a list that a row may hold."""
    found = whole(rows, GROUP, BY_TIME, **_looks_back())
    found = found.withColumns({"_place": F.when(_traced(), F.struct("page_id", "ink.space", "ink.domain")), "_box": F.col("ink.box")})
    place = Window.partitionBy(*GROUP, "question_id", "_place").orderBy(*BY_TIME).rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("_ink", F.collect_list(F.when(F.col("_place").isNotNull() & F.col("writes"), F.col("_box"))).over(place))
    # Rows are sorted by place already, so by question.
    found = found.withColumn("_first", F.min(F.when(F.col("is_mapped"), F.struct(*BY_TIME))).over(Window.partitionBy(*GROUP, "question_id")))
    meets = F.exists("_ink", lambda b: overlap(F.col("_box"), b, 1.0) >= config.revision_overlap_threshold)
    return _with_states(found.withColumn("overlaps", F.when(F.col("_place").isNotNull(), meets)).drop("_place", "_box", "_ink"), config)


def long_states(rows: DataFrame, config: EventConfig, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """mappings with what came before each: active mapping, known page, visits, pause, overlap with earlier ink. They are read several
    times, so it is best if they are a written table."""
    rows = rows.withColumns({"_bucket": F.floor(F.col("_start") / BUCKET_MS), "_prefix": F.when(F.col("_untimed"), F.substring("stroke_id", 1, PREFIX)).otherwise("")})
    marks = rows.where(_traced()).select(
        *GROUP, "question_id", "page_id", F.col("ink.space").alias("space"), F.col("ink.domain").alias("domain"), F.col("ink.box").alias("box"), "writes", F.struct(*BY_TIME).alias("at"), "stroke_id"
    )
    known = by_counts(rows, GROUP, ("_untimed", "_bucket", "_prefix"), piece_rows)
    known = scan(known, GROUP, BY_TIME, **_looks_back()).drop("_piece")
    # Each question's first mapping; later ones come back to it.
    first = rows.where("is_mapped").groupBy(*GROUP, "question_id").agg(F.min(F.struct(*BY_TIME)).alias("_first"))
    found = known.join(first, [*GROUP, "question_id"], "left")
    laps = touched(marks, (*GROUP, "question_id", "page_id", "space", "domain"), config.revision_overlap_threshold).select(*GROUP, "stroke_id", F.lit(True).alias("overlaps"))
    return _with_states(found.join(laps, [*GROUP, "stroke_id"], "left"), config)


def detect_events(
    mappings: DataFrame, config: EventConfig | None = None, process_end_signal: bool = False, session_end_ms: int | None = None, task_segment_id: str | None = None,
    keep: Callable[[DataFrame, str], DataFrame] = _keep, piece_rows: int = PIECE_ROWS, known: int | None = None, placed: bool = False,
) -> DataFrame:
    """A row per event, numbered per session in order. task_segment_id: of events whose mapping has none. keep: writes a table and reads
    it again, since the mappings' events are both counted and numbered. known, placed: as in scan.by_length."""
    c = config or EventConfig()
    made = _events(c, process_end_signal, session_end_ms, task_segment_id)
    in_session = ("session_id",), ("_untimed", "_start", "participant_bucket", "segment_bucket", "stroke_id")
    total = {"_upto": F.size("_events").cast("long")}

    def long(rows: DataFrame) -> DataFrame:
        rows = long_states(rows, c, piece_rows)
        late = [F.when(F.col("_untimed"), F.col(c)).otherwise("").alias(f"_late_{c}") for c in GROUP[1:]]
        found = rows.select(*GROUP, "participant_id", *BY_TIME, "_bucket", *late, "_prefix", made.alias("_events"))
        found = by_counts(keep(found.where(F.size("_events") > 0), "mapping-events"), ("session_id",), ("_untimed", "_bucket", *[f"_late_{c}" for c in GROUP[1:]], "_prefix"), piece_rows)
        return _numbered(scan(found, *in_session, total=total))

    def short(rows: DataFrame) -> DataFrame:
        found = short_states(rows, c).select(*GROUP, "participant_id", *BY_TIME, made.alias("_events"))
        return _numbered(whole(found, *in_session, total=total))

    return by_length(_prepared(mappings), "session_id", min(SHORT, piece_rows), short, long, known=known, placed=placed)


def _numbered(found: DataFrame) -> DataFrame:
    """A row per event, numbered by the mappings' events before its mapping's in the session, and its place among these."""
    # Fields are named one by one: a star would take the columns of a table of the struct's name, if the caller's table has that name.
    fields = [F.col("_event")[f].alias(f) for f in found.schema["_events"].dataType.elementType.names]
    found = found.select("session_id", "participant_id", (F.col("_upto") - F.size("_events")).alias("_before"), F.posexplode("_events").alias("_k", "_event"))
    found = found.withColumn("sequence", F.col("_before") + F.col("_k"))
    return found.select(F.format_string("%s:event:%04d", "session_id", "sequence").alias("event_id"), "session_id", "participant_id", "sequence", *fields, F.lit(VERSION).alias("algorithm_version"))


def _events(c: EventConfig, process_end_signal: bool, session_end_ms: int | None, task_segment_id: str | None) -> Column:
    """Array of the events of a mapping with its states, in order."""
    own, active = F.struct(*CARRIED), F.col("_active")
    text = lambda v: F.lit(None).cast("string") if v is None else (F.lit(v) if isinstance(v, str) else v)

    def event(kind, source, question=None, previous=None, following=None, at=None, confidence=None, flags=None, meta=None):
        kind = F.lit(kind) if isinstance(kind, str) else kind
        start, end = (at, at) if at is not None else (source["start_time_ms"], source["end_time_ms"])
        extra = named(F.when(start.isNull() | end.isNull(), "TIME_UNAVAILABLE"))
        all_flags = F.array_distinct(F.concat(source["quality_flags"], flags if flags is not None else F.array().cast("array<string>"), extra))
        return F.struct(
            kind.alias("event_type"), text(question).alias("question_id"), text(previous).alias("previous_question_id"), text(following).alias("next_question_id"),
            source["page_id"].alias("page_id"), start.alias("start_time_ms"), end.alias("end_time_ms"), source["stroke_id"].alias("stroke_ref"), source["point_refs"].alias("point_refs"),
            all_flags.alias("quality_flags"), F.when((F.size(all_flags) > 0) | (source["status"] != "MAPPED"), "DEGRADED").otherwise("VALID").alias("quality_status"),
            (confidence if confidence is not None else F.lit(None).cast("double")).alias("mapping_confidence"), text(meta).alias("reason"), F.coalesce(F.when(source["task_segment_id"] != "", source["task_segment_id"]), F.lit(task_segment_id).cast("string")).alias("task_segment_id"),
        )

    mapped, changed, confidence = F.col("is_mapped"), F.col("page_changed"), F.col("confidence")
    has_active = active.isNotNull()
    again = has_active & (active["question_id"] == F.col("question_id")) & ~changed
    revisited = F.col("_seen") & (~has_active | (active["question_id"] != F.col("question_id")) | changed)
    arrival = F.when(revisited, "RETURN").otherwise("QUESTION_VISIT")
    q = F.col("question_id")
    end = F.lit(process_end_signal)
    why = F.lit("explicit_signal" if process_end_signal else None).cast("string")
    if session_end_ms is not None and c.process_end_timeout_ms is not None:
        late = F.coalesce(session_end_ms - F.col("end_time_ms") >= c.process_end_timeout_ms, F.lit(False))
        end, why = end | late, F.when(late, "session_timeout").otherwise(why)
    # Events of a mapping are in this order; of each type at most one is there.
    return F.array_compact(
        F.array(
            F.when(changed, event("PAGE_CHANGE", own, confidence=confidence, meta=F.concat_ws(">", "_page", "page_id"))),
            F.when(F.col("writes"), event("WRITING", own, F.when(mapped, q), confidence=confidence)),
            F.when(~mapped & has_active, event("QUESTION_LEAVE", active, active["question_id"], at=active["end_time_ms"], meta="mapping_unavailable")),
            F.when(mapped & has_active & ~again, event("QUESTION_LEAVE", active, active["question_id"], following=q, at=active["end_time_ms"])),
            F.when(mapped & ~has_active, event(arrival, own, q, confidence=confidence)),
            F.when(mapped & has_active & ~again, event(arrival, own, q, previous=active["question_id"], confidence=confidence)),
            F.when(mapped & again & F.col("paused") & F.col("overlaps"), event("REVISION_CANDIDATE", own, q, confidence=confidence, meta="prior_ink_pause_or_revisit_overlap")),
            F.when(mapped & has_active & ~again & F.col("overlaps"), event("REVISION_CANDIDATE", own, q, confidence=confidence, meta="reentry_overlap")),
            F.when(~mapped, event("UNKNOWN", own, "UNKNOWN", flags=F.when(F.size("quality_flags") > 0, F.col("quality_flags")).otherwise(F.array(F.lit("UNKNOWN_MAPPING"))), meta=F.col("status"))),
            F.when(F.col("_last") & end, event("PROCESS_END", own, F.when(mapped, q), at=F.col("end_time_ms"), meta=why)),
        )
    )
