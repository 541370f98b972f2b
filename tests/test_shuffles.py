"""Sessions that a task holds are shuffled once; short and long ones give the same rows."""

import pytest
from pyspark.sql import functions as F

from inkwell.operators import events, features, mapping, parse, strokes, trace, wire
from inkwell.plans import catalogue
from inkwell.sources import pen, store

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def shuffles(df):
    """Shuffles in the plan that was run in the end, those of broadcast sides included."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Final Plan" in plan
    return plan.split("Initial Plan")[0].count("Exchange hashpartitioning")


@pytest.fixture(scope="module")
def tables(spark):
    keep = store.keeper(spark, "test")
    points = keep(parse.parse_points(pen.pen_points(spark, SF)), "points")
    found = keep(strokes.build_strokes(points, pen.STROKES), "strokes")
    mapped = keep(mapping.map_strokes(found, pen.pen_regions(spark), pen.MAPPING), "mappings")
    return points, found, mapped, keep(events.detect_events(mapped, pen.EVENTS, session_end_ms=pen.SESSION_END_MS), "events")


def test_short_sessions_are_shuffled_once(spark, tables):
    points, found, mapped, _ = tables
    # One of the rows, and one of the counts of sessions.
    assert shuffles(strokes.build_strokes(points, pen.STROKES)) <= 2
    assert shuffles(events.detect_events(mapped, pen.EVENTS, session_end_ms=pen.SESSION_END_MS)) <= 2
    # Strokes stay where they are if no page has many regions; these are grouped by page twice.
    assert shuffles(mapping.map_strokes(found, pen.pen_regions(spark), pen.MAPPING)) <= 2


def test_lists_of_regions_give_what_the_grid_gives(spark, tables, monkeypatch):
    found = tables[1]
    raw = pen.pen_regions(spark).withColumns({"coordinate_space": F.lit("legacy"), "region_id": F.concat("region_id", F.lit("-raw"))})
    odd = spark.createDataFrame([("empty", "page-1", "q9", 0, [], "norm"), ("elsewhere", None, "q9", 0, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], "norm")], pen.pen_regions(spark).schema)
    regions = pen.pen_regions(spark).unionByName(raw).unionByName(odd)
    listed = rows_of(mapping.map_strokes(found, regions, pen.MAPPING))
    monkeypatch.setattr(mapping, "FEW", 0)
    assert rows_of(mapping.map_strokes(found, regions, pen.MAPPING)) == listed


@pytest.mark.parametrize("threshold", [0.0, 0.1, 1.0])
def test_ink_of_short_sessions_is_that_of_the_grid(tables, threshold):
    mapped = tables[2]
    again = mapped.withColumns({"session_id": F.lit("s"), "participant_id": F.lit("u"), "task_segment_id": F.lit("g"), "stroke_id": F.concat_ws("/", "session_id", "stroke_id")})
    config = events.EventConfig(revision_pause_threshold_ms=0, revision_overlap_threshold=threshold)
    made = [rows_of(events.detect_events(again, config, piece_rows=n)) for n in (3, 1 << 16)]
    assert made[0] == made[1] and (threshold == 1 or any("REVISION_CANDIDATE" in r for r in made[0]))


def test_lists_of_ids_give_what_joins_give(spark, tables, monkeypatch):
    points, found, _, made = tables
    # A null reference, one to nothing, an unknown stroke, and a session whose points are told twice.
    k = F.col("sequence") % 11
    refs = F.when(k == 1, F.concat("point_refs", F.array(F.lit(None).cast("string")))).when(k == 2, F.concat("point_refs", F.array(F.lit("none")))).when(k == 3, F.slice("point_refs", 1, 1)).when(k == 5, None).otherwise(F.col("point_refs"))
    made = made.withColumns({"point_refs": refs, "stroke_ref": F.when(k == 4, "none").when(k == 6, None).otherwise(F.col("stroke_ref"))})
    single = points.dropDuplicates(["session_id", "point_id"])
    single = single.unionByName(single.where("session_id = 's-1' AND raw_order = 0"))
    wired = wire.wire_events(made)
    listed = rows_of(trace.traces(made, found, single)), rows_of(wire.unresolved(wired, points.where("raw_order % 7 <> 3"), found.where("stroke_index % 5 <> 2")))
    monkeypatch.setattr(trace, "LISTED", 0)
    monkeypatch.setattr(wire, "LISTED", 0)
    joined = rows_of(trace.traces(made, found, single)), rows_of(wire.unresolved(wired, points.where("raw_order % 7 <> 3"), found.where("stroke_index % 5 <> 2")))
    assert [sorted(set(a) ^ set(b)) for a, b in zip(listed, joined, strict=True)] == [[], []]
    assert all(any(e in r for r in listed[0]) for e in ("DUPLICATE_POINT_ID", "MISSING_STROKE", "MISSING_POINT", "UNCOVERED_STROKE_POINT"))


def test_features_of_long_participants(spark, tables, monkeypatch):
    mapped = tables[2]
    splits = mapped.select("participant_id").distinct().where("participant_id <> 'u-1'").withColumn("split", F.lit("train"))
    short = [rows_of(features.episodes(mapped, pen.FEATURES, s)) for s in (None, splits)]
    monkeypatch.setattr(features, "PIECE_ROWS", 5)
    assert [rows_of(features.episodes(mapped, pen.FEATURES, s)) for s in (None, splits)] == short
    assert 0 < len(short[1]) < len(short[0])


def test_a_stored_dataset_is_one_run(spark, monkeypatch):
    folders, real = [], store.scratch_dir
    monkeypatch.setattr(store, "scratch_dir", lambda s, what: folders.append(what) or real(s, what))
    assert {r["table"]: r["n"] for r in catalogue._stored(spark, SF).collect()}["points"] == 1000
    assert folders.count("run") == 1
