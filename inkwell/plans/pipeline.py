"""The whole run: points, and strokes with their mappings, as written tables, since each is read several times; the rest lazily. Where one
table is all that is wanted, and sessions are short, nothing before it is written: a session's points are shuffled once, and its strokes,
mappings and events are made where they lie."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.config import EventConfig, MappingConfig, StrokeConfig
from inkwell.operators import events, mapping, parse, replay, scan, strokes, trace
from inkwell.sources import store


@dataclass(frozen=True)
class Run:
    points: DataFrame
    strokes: DataFrame
    mappings: DataFrame
    events: DataFrame

    @property
    def frames(self) -> DataFrame:
        return replay.replay_frames(self.points, self.strokes)

    @property
    def traces(self) -> DataFrame:
        return trace.traces(self.events, self.strokes, self.points)

    @property
    def status(self) -> DataFrame:
        return trace.run_status(self.points, self.strokes, self.mappings, self.events, self.traces)


def run(
    records: DataFrame, regions: DataFrame, stroke_config: StrokeConfig | None = None, mapping_config: MappingConfig | None = None, event_config: EventConfig | None = None,
    process_end_signal: bool = False, session_end_ms: int | None = None, session_id: str | None = None, task_segment_id: str | None = None, adapter: Callable[[DataFrame], DataFrame] | None = None,
    keep: Callable[[DataFrame, str], DataFrame] | None = None, keep_events: bool = False, one_pass: bool = False, placed: bool = False,
    counted: DataFrame | None = None,
) -> Run:
    """adapter: from a device's records to canonical ones. session_id, task_segment_id: what all points must belong to; others raise
    when they are read. keep: writes a table and reads it again; by default to a scratch folder. keep_events: whether the events are
    written too, for a run of which several tables are wanted. one_pass: that one table of the run is read, once; points are then
    written only if a session is longer than a task holds, and mappings only if one has more points than events.SHORT. Any table may be
    read all the same, it is then made anew. placed: whether the records come from an operator that has put each session's together; they
    aren't shuffled again then. counted: what has as many rows of each session as the records and is cheaper to read."""
    keep = keep or store.keeper(records.sparkSession, "run")
    records = adapter(records) if adapter else records
    most = scan.longest(records if counted is None else counted, "session_id")
    points = guard(parse.parse_points(records, known=most, placed=placed), session_id, task_segment_id)
    flows = one_pass and most <= scan.PIECE_ROWS
    points = points if flows else keep(points, "points")
    few = mapping.listed(regions)
    through = flows and few and most <= events.SHORT
    found, mapped = _mapped(strokes.build_strokes(points, stroke_config, known=most, placed=flows), regions, mapping_config, (lambda df, name: df) if through else keep, few)
    # A session has no more mappings than points.
    made = events.detect_events(mapped, event_config, process_end_signal, session_end_ms, task_segment_id, keep, known=most, placed=through)
    return Run(points, found, mapped, keep(made, "events") if keep_events else made)


def _mapped(found: DataFrame, regions: DataFrame, config: MappingConfig | None, keep: Callable[[DataFrame, str], DataFrame], few: bool) -> tuple[DataFrame, DataFrame]:
    """Strokes and mappings. They are one written table where a stroke's mapping needs no join, since most columns of theirs are the same."""
    if not few:
        found = keep(found, "strokes")
        return found, keep(mapping.map_strokes(found, regions, config, few=few), "mappings")
    own = ("n_points", "duration_ms", "processed_order", "path_length_norm", "algorithm_version")
    both = keep(mapping.map_strokes(found, regions, config, own, few), "mappings")
    return both.select(*[F.col("stroke_flags").alias(c) if c == "quality_flags" else c for c in found.columns]), both.drop(*own)


def guard(points: DataFrame, session_id: str | None, task_segment_id: str | None) -> DataFrame:
    """points, which raise when they are read if one is of another session, or of another known segment."""
    checks = ((("session_id", session_id), F.col("session_id") != F.lit(session_id)), (("task_segment_id", task_segment_id), F.col("task_segment_id") != F.lit(task_segment_id)))
    for (name, wanted), other in checks:
        if wanted is not None:
            points = points.withColumn(name, F.when(other, F.raise_error(F.concat(F.lit(f"{name} isn't {wanted}: "), F.col(name))).cast("string")).otherwise(F.col(name)))
    return points
