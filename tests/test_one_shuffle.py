"""Sessions that stand together already aren't shuffled again, and points are sorted once for each order."""

from pyspark.sql import functions as F

from inkwell.functions import geometry
from inkwell.operators import events, parse, strokes
from inkwell.plans import catalogue
from inkwell.sources import pen
from tests.test_shared_run import CONVEX, KIND, OTHER
from tests.test_shuffles import rows_of, tables  # noqa: F401

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_run_shuffles_the_records_once(spark):
    plan = plan_of(catalogue._lazy_run(spark, SF).mappings)
    assert plan.count("Exchange hashpartitioning(session_id") == 1 and "Exchange hashpartitioning(user_id" not in plan
    # As many parts as are asked for: adaptive execution would make a few more than there are cores.
    assert plan.split("Exchange hashpartitioning(session_id")[1].split("\n")[0].count("REPARTITION_BY_NUM") == 1


def test_strokes_are_made_without_groups_and_with_a_sort_for_each_order(spark):
    points = parse.parse_points(pen.pen_points(spark, SF), known=1, placed=True)
    plan = plan_of(strokes.build_strokes(points, pen.STROKES, known=1, placed=True))
    assert "Aggregate" not in plan
    # The fixture's numbers; a page's points; a point's copies; the session; its strokes.
    assert plan.count("Sort [") == 5


def test_records_that_stand_together_give_what_others_give(spark):
    made = [strokes.build_strokes(parse.parse_points(pen.pen_points(spark, SF).repartition(3), placed=False), pen.STROKES), strokes.build_strokes(parse.parse_points(pen.pen_points(spark, SF), placed=True), pen.STROKES)]
    assert rows_of(made[0]) == rows_of(made[1])


def test_counts_of_ids_are_those_of_points(spark):
    points = pen.pen_points(spark, SF)
    assert rows_of(pen.pen_ids(spark, SF).groupBy("session_id", "participant_id").count()) == rows_of(points.groupBy("session_id", "participant_id").count())


def test_single_points_are_inside_as_lines_of_one_are(spark):
    at = [(x / 4, y / 4) for x in range(-1, 6) for y in range(-1, 6)]
    rows = spark.createDataFrame([(i, v, [p]) for i, v in enumerate(CONVEX + OTHER[:3]) for p in at] + [(0, CONVEX[0], [None])], KIND)
    rows = rows.withColumns({"line": geometry.line(F.col("p")), "shape": geometry.shape(F.col("v")), "own": F.get("p", F.lit(0))})
    general = F.col("shape").withField("rect", F.lit(None).cast("struct<left: double, top: double, right: double, bottom: double>"))
    own = F.when(geometry.point_inside(F.col("own.x"), F.col("own.y"), F.col("shape")), 1.0).otherwise(0.0)
    found = rows.select("i", "p", own.alias("a"), geometry.shape_coverage(F.col("line"), general).alias("b")).collect()
    assert [(r["i"], r["p"]) for r in found if r["b"]["method"] != "POINT_FALLBACK" or r["a"] != r["b"]["share"]] == []
    assert {r["a"] for r in found} == {0.0, 1.0}


def test_numbers_and_complete_lists(spark):
    rows = spark.createDataFrame([(0, []), (7, [None]), (9999, [1.0]), (10000, [1.0, None]), (123456, [1.0, 2.0])], "n long, v array<double>")
    got = rows.select(geometry.numbered("stroke-", F.col("n")).alias("id"), geometry.complete(F.col("v")).alias("all")).collect()
    assert [tuple(r) for r in got] == [("stroke-0000", True), ("stroke-0007", False), ("stroke-9999", True), ("stroke-10000", False), ("stroke-123456", True)]


def test_events_are_whole_whatever_the_callers_table_is_called(spark, tables):  # noqa: F811
    _, _, mapped, made = tables
    # The fixture's records come from a table called e.
    assert catalogue._lazy_run(spark, SF).events.columns == made.columns
    for name, piece_rows in (("e", 3), ("e", 1 << 16), ("_event", 1 << 16)):
        again = events.detect_events(mapped.alias(name), pen.EVENTS, session_end_ms=pen.SESSION_END_MS, piece_rows=piece_rows)
        assert again.columns == made.columns and rows_of(again) == rows_of(made), (name, piece_rows)
