"""The step that all pen runs share: convex regions, sessions without a longer one, strokes and mappings in one table."""

import random

from pyspark.sql import functions as F

from inkwell.functions import geometry
from inkwell.operators import events, mapping, parse, strokes, trace, wire
from inkwell.plans import pipeline
from inkwell.sources import pen
from tests.test_shuffles import rows_of, tables  # noqa: F401

SF = "/root/testdata/sf0.001"
KIND = "i int, v array<struct<x: double, y: double>>, p array<struct<x: double, y: double>>"
CONVEX = [
    [(0.0, 0.0), (1.0, 0.0), (1.0, 0.5), (0.0, 0.5)], [(0.0, 0.5), (1.0, 0.5), (1.0, 0.0), (0.0, 0.0)], [(0.0, 0.0), (1.0, 0.0), (0.5, 0.75)],
    [(0.0, 0.0), (1.0, 0.0), (1.0, 0.5), (0.0, 0.5), (0.0, 0.0)], [(0.0, 0.0), (0.5, 0.0), (1.0, 0.0), (1.0, 1.0), (0.25, 1.0)], [(100.0, 50.0), (400.0, 50.0), (400.0, 300.0), (250.0, 350.0), (100.0, 300.0)],
]
OTHER = [
    [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.5, 0.25), (0.0, 1.0)], [(0.5, 1.0), (0.8, 0.0), (0.0, 0.6), (1.0, 0.6), (0.2, 0.0)], [(0.0, 0.0), (1.0, 1.0), (1.0, 0.0), (0.0, 1.0)],
    [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)] * 2, [(0.0, 0.0), (1.0, 0.0), (0.5, 0.0)], [(0.0, 0.0), (1.0, 1.0)],
]


def test_convex_polygons_give_what_all_polygons_give(spark):
    rnd = random.Random(3)
    lines = []
    for i, v in enumerate(CONVEX):
        size = max(max(p) for p in v)
        for k in range(150):
            # Points on a lattice fall on corners and sides, and lines along these.
            at = (lambda: rnd.randrange(-1, 6) / 4 * size) if k % 2 else (lambda: rnd.uniform(-0.25, 1.25) * size)
            lines.append((i, v, [(at(), at()) for _ in range(1 + k % 4)]))
    df = spark.createDataFrame(lines, KIND).withColumns({"line": geometry.line(F.col("p")), "shape": geometry.shape(F.col("v"))})
    general = F.col("shape").withField("planes", F.lit(None).cast("array<struct<x: double, y: double, c: double>>"))
    rows = df.select("i", "p", F.col("shape.planes").isNotNull().alias("flat"), geometry.shape_coverage(F.col("line"), F.col("shape")).alias("a"), geometry.shape_coverage(F.col("line"), general).alias("b")).collect()
    assert all(r["flat"] for r in rows)
    assert [(r["i"], r["p"]) for r in rows if r["a"]["method"] != r["b"]["method"] or abs(r["a"]["share"] - r["b"]["share"]) > 1e-8] == []
    assert {r["a"]["method"] for r in rows} == {"ARC_LENGTH", "POINT_FALLBACK"} and any(0.1 < r["a"]["share"] < 0.9 for r in rows)


def test_other_polygons_are_clipped_in_general(spark):
    rows = spark.createDataFrame([(i, v, []) for i, v in enumerate(OTHER)], KIND)
    assert rows.where(geometry.shape(F.col("v"))["planes"].isNotNull()).count() == 0


def test_rows_are_read_once_where_no_session_is_longer(spark, tables):  # noqa: F811
    points, found, mapped, made = tables
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for df in (
        parse.parse_points(pen.pen_points(spark, SF)), strokes.build_strokes(points, pen.STROKES), events.detect_events(mapped, pen.EVENTS), trace.traces(made, found, points),
        wire.unresolved(wire.wire_events(made), points, found),
    ):
        assert "Union" not in plan(df)
    assert "Union" in plan(strokes.build_strokes(points, pen.STROKES, piece_rows=5))


def test_strokes_and_mappings_are_one_table(spark, tables, monkeypatch):  # noqa: F811
    _, found, mapped, _ = tables
    again = lambda: pipeline.run(pen.pen_points(spark, SF), pen.pen_regions(spark), pen.STROKES, pen.MAPPING, pen.EVENTS)
    one = again()
    assert one.strokes.inputFiles() == one.mappings.inputFiles()
    assert one.strokes.columns == found.columns and one.mappings.columns == mapped.columns
    assert rows_of(one.strokes) == rows_of(found) and rows_of(one.mappings) == rows_of(mapped)
    monkeypatch.setattr(mapping, "FEW", 0)
    two = again()
    assert two.strokes.inputFiles() != two.mappings.inputFiles() and rows_of(two.mappings) == rows_of(mapped)


def test_one_table_of_short_sessions_is_made_without_writing(spark, tables, monkeypatch):  # noqa: F811
    _, _, mapped, made = tables
    written = []

    def again(**how):
        written.clear()
        return pipeline.run(pen.pen_points(spark, SF), pen.pen_regions(spark), pen.STROKES, pen.MAPPING, pen.EVENTS, session_end_ms=pen.SESSION_END_MS, keep=lambda df, name: written.append(name) or df, **how)

    one = again(one_pass=True)
    assert written == [] and rows_of(one.events) == rows_of(made) and rows_of(one.mappings) == rows_of(mapped)
    # A session's points are shuffled once, and all that follows is made where they lie.
    assert one.events._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(session_id") == 1
    again()
    assert written == ["points", "mappings"]
    monkeypatch.setattr(events, "SHORT", 5)
    again(one_pass=True)
    assert "mappings" in written and "points" not in written
    monkeypatch.setattr(pipeline.scan, "PIECE_ROWS", 5)
    again(one_pass=True)
    assert "points" in written and "mappings" in written


def test_rectangles_are_clipped_without_their_sides(spark):
    rnd = random.Random(5)
    lines = []
    for k in range(400):
        at = (lambda: rnd.randrange(-1, 6) / 4) if k % 2 else (lambda: rnd.uniform(-0.25, 1.25))
        lines.append((k % 2, CONVEX[k % 2], [(at(), at()) for _ in range(1 + k % 4)]))
    df = spark.createDataFrame(lines, KIND).withColumns({"line": geometry.line(F.col("p")), "shape": geometry.shape(F.col("v"))})
    by_sides = F.col("shape").withField("rect", F.lit(None).cast("struct<left: double, top: double, right: double, bottom: double>"))
    rows = df.select("p", F.col("shape.rect").alias("rect"), geometry.shape_coverage(F.col("line"), F.col("shape")).alias("a"), geometry.shape_coverage(F.col("line"), by_sides).alias("b")).collect()
    assert all(tuple(r["rect"]) == (0.0, 0.0, 1.0, 0.5) for r in rows)
    assert [r["p"] for r in rows if r["a"]["method"] != r["b"]["method"] or abs(r["a"]["share"] - r["b"]["share"]) > 1e-12] == []
    triangle = spark.createDataFrame([(0, CONVEX[2], []), (1, CONVEX[5], [])], KIND)
    assert triangle.where(geometry.shape(F.col("v"))["rect"].isNotNull()).count() == 0
