"""Sessions, questions and pages that are more than a task holds: the same rows as by plain windows and plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from inkwell.config import MappingConfig
from inkwell.operators import events, ink, mapping, parse, scan, strokes
from inkwell.plans import pipeline
from inkwell.sources import pen, store

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def tables(spark):
    keep = store.keeper(spark, "test")
    points = keep(parse.parse_points(pen.pen_points(spark, SF)), "points")
    found = keep(strokes.build_strokes(points, pen.STROKES), "strokes")
    return points, found, keep(mapping.map_strokes(found, pen.pen_regions(spark), pen.MAPPING), "mappings")


def test_scans_agree_with_windows(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("abc"), k, rnd.choice([None, 1, 2, 3]), rnd.randrange(5)) for k in range(500)] + [("alone", 1, None, 1)]
    df = spark.createDataFrame(rows, "key string, at long, x int, y int").withColumn("_piece", scan.by_number(F.col("at"), 7))
    own = Window.partitionBy("key").orderBy("at")
    plain = df.withColumns({"was": F.lag("x").over(own), "known": F.last("x", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1)), "upto": F.sum("y").over(own), "end": F.lead("at").over(own).isNull()})
    found = scan.scan(df, ("key",), ("at",), lag={"was": F.col("x")}, last={"known": F.col("x")}, total={"upto": F.col("y").cast("long")}, ends="end")
    assert rows_of(found) == rows_of(plain)
    cut = scan.by_counts(df.drop("_piece"), ("key",), ("at",), 11)
    assert cut.groupBy("key", "_piece").count().agg(F.max("count")).first()[0] <= 11 + 1
    again = scan.scan(cut, ("key",), ("at",), total={"upto": F.col("y").cast("long")})
    assert rows_of(again.select("key", "at", "upto")) == rows_of(plain.select("key", "at", "upto"))


def test_pieces_change_nothing(spark, tables):
    points, found, mapped = tables
    assert rows_of(parse.parse_points(pen.pen_points(spark, SF), 5)) == rows_of(points)
    assert rows_of(strokes.build_strokes(points, pen.STROKES, 5)) == rows_of(found)
    made = [events.detect_events(mapped, pen.EVENTS, session_end_ms=pen.SESSION_END_MS, piece_rows=n) for n in (3, 1 << 16)]
    assert rows_of(made[0]) == rows_of(made[1])
    # Without times, mappings are in the order of their numbers, and in pieces all the same.
    late = mapped.withColumns({c: F.lit(None).cast("long") for c in ("start_time_ms", "end_time_ms")})
    made = [events.detect_events(late, pen.EVENTS, piece_rows=n) for n in (3, 1 << 16)]
    assert rows_of(made[0]) == rows_of(made[1])


def test_one_session_with_most_rows_takes_many_tasks(spark):
    n = 30_000
    rows = spark.range(n + 1000).select(
        F.when(F.col("id") < n, "hot").otherwise(F.concat(F.lit("s-"), F.col("id") % 7)).alias("session_id"), F.concat(F.lit("p"), "id").alias("point_id"), F.lit("page-1").alias("page_id"),
        F.col("id").alias("raw_order"), F.col("id").cast("double").alias("sequence"), (F.col("id") * 10 + F.when(F.col("id") % 50 == 0, 20_000).otherwise(0)).alias("timestamp_ms"),
        (F.col("id") % 90 / 100).alias("x"), F.lit(0.5).alias("y"), F.lit("MOVE").alias("pen_state"),
    )
    points = store.keeper(spark, "test")(parse.parse_points(rows, 1000), "points")
    # As on a large table: no side is small enough to be broadcast, no partitions are put together.
    large = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in large.items():
        spark.conf.set(k, v)
    try:
        made = strokes.with_stroke_index(points, piece_rows=1000).where("session_id = 'hot'").withColumn("_task", F.spark_partition_id())
        tasks = made.groupBy("_task").agg(F.count("stroke_index").alias("n"), F.max("stroke_index")).collect()
        assert len(tasks) > 1 and max(r["n"] for r in tasks) < 0.8 * n
    finally:
        for k in large:
            spark.conf.unset(k)
    index = made.groupBy().agg(F.max("stroke_index"), F.count("*"), F.count_distinct("stroke_index")).first()
    assert index[1] == n and index[0] == index[2] > n / 60


def boxes_iou(a, b):
    w = np.minimum(a[2], b[:, 2]) - np.maximum(a[0], b[:, 0])
    h = np.minimum(a[3], b[:, 3]) - np.maximum(a[1], b[:, 1])
    both = np.maximum(w, 0) * np.maximum(h, 0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1]) - both
    equal = (b == np.array(a)).all(axis=1)
    return np.where(union <= 1e-12, equal.astype(float), both / np.where(union == 0, 1, union))


MARK = "g string, box struct<left: double, top: double, right: double, bottom: double>, at struct<t: long>, writes boolean, id long"


@pytest.mark.parametrize("threshold", [0.0, 0.02, 0.1, 0.25, 0.9, 1.0])
def test_earlier_ink_in_the_grid_is_all_earlier_ink(spark, threshold):
    rnd = random.Random(8)
    rows = []
    for k in range(400):
        w, h = 4.0 ** rnd.uniform(-6, 0), 4.0 ** rnd.uniform(-6, 0)
        x, y = rnd.choice([-0.5, 0.25, rnd.random()]), rnd.choice([0.0, rnd.random()])
        if k % 17 == 0:
            w = 0.0
        if k % 23 == 5 and rows:
            x, y, x2, y2 = rnd.choice(rows)[1]
        else:
            x2, y2 = x + w, y + h
        rows.append((rnd.choice("ab"), (x, y, x2, y2), (rnd.randrange(10_000),), rnd.random() < 0.8, k))
    found = {r["id"] for r in ink.touched(spark.createDataFrame(rows, MARK), ["g"], threshold).collect()}
    expected = set()
    for g, box, (t,), _, k in rows:
        before = np.array([b for h, b, (u,), writes, _ in rows if h == g and u < t and writes])
        if len(before) and (boxes_iou(box, before) >= threshold).any():
            expected.add(k)
    assert found == expected and expected


def test_a_hundred_thousand_strokes_on_one_question(spark):
    n = 100_000
    rng = np.random.default_rng(4)
    x, y, w, h = rng.random(n) * 0.9, rng.random(n) * 0.9, 0.0005 + 0.001 * rng.random(n), 0.0005 + 0.001 * rng.random(n)
    b = np.stack([x, y, x + w, y + h], axis=1)
    b[n // 2 :: 2] = b[: n // 4]  # written again in the same place
    rows = spark.createDataFrame([("q", tuple(map(float, v)), (k,), True, k) for k, v in enumerate(b)], MARK).repartition(8)
    found = {r["id"] for r in ink.touched(rows, ["g"], 0.1).select("id").collect()}
    for k in [*range(0, 300), *range(n - 300, n)]:
        assert (k in found) == bool(k and (boxes_iou(b[k], b[:k]) >= 0.1).any())
    assert found >= set(range(n // 2, n, 2))


def test_ten_thousand_regions_on_one_page(spark, tables):
    side = 100
    cells = [(f"r-{i}-{j}", "page-1", f"q-{i}-{j}", 0, [(i / side, j / side), ((i + 1) / side, j / side), ((i + 1) / side, (j + 1) / side), (i / side, (j + 1) / side)], "norm") for i in range(side) for j in range(side)]
    schema = "region_id string, page_id string, question_id string, priority int, polygon array<struct<x: double, y: double>>, coordinate_space string"
    regions = spark.createDataFrame([*cells, ("whole", "page-1", "all", -1, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)], "norm")], schema).repartition(8)
    rnd = random.Random(6)
    records, expected = [], {}
    for k in range(300):
        i, j = rnd.randrange(side), rnd.randrange(side)
        x, y = (i + 0.2) / side, (j + 0.3) / side
        far = k % 3 == 0  # in no cell by half, so only the region around all has it
        for p in range(2):
            records.append((f"p-{k}-{p}", "s", "u", "g", "d", "page-1", 2 * k + p, float(2 * k + p), float(k * 5000 + 50 * p), 0.0, 0.0, min(x + p * (0.1 if far else 0.004), 1.0), y, "DOWN" if p == 0 else "UP"))
        expected[k] = "whole" if far else f"r-{i}-{j}"
    record = "point_id string, session_id string, participant_id string, task_segment_id string, device_id string, page_id string, raw_order long, sequence double, timestamp_ms double, x double, y double, x_norm double, y_norm double, pen_state string"
    made = strokes.build_strokes(parse.parse_points(spark.createDataFrame(records, record)))
    made = store.keeper(spark, "test")(made.where("n_points = 2"), "strokes")
    found = {int(r["point_refs"][0].split("-")[1]): r for r in mapping.map_strokes(made, regions).collect()}
    assert len(found) > 250
    for k, r in found.items():
        if expected[k] != "whole":
            # The small cell and the page are both wholly covered; priority puts the cell first.
            assert (r["region_id"], r["status"]) == (expected[k], "MAPPED"), k
        else:
            assert r["region_id"] == "whole"
    near = mapping.near_regions(made, regions).select(F.size("regions").alias("n")).agg(F.max("n")).first()[0]
    assert near <= 60


def test_the_grid_gives_what_all_regions_give(spark, tables):
    _, found, mapped = tables
    regions = pen.pen_regions(spark).collect()
    raw = [(r["region_id"] + "-raw", r["page_id"], r["question_id"] + "r", 0, [(p["x"] * 500, p["y"] * 400) for p in r["polygon"]], "legacy") for r in regions]
    both = pen.pen_regions(spark).unionByName(spark.createDataFrame(raw, pen.pen_regions(spark).schema))
    # One region at a time: those that reach the least share are the candidates.
    made = mapping.candidates(found, both, MappingConfig())
    together = {(r["session_id"], r["stroke_id"]): {b["region_id"]: b["coverage"] for b in r["best"]} for r in made.collect()}
    alone: dict = {k: {} for k in together}
    from inkwell.functions.geometry import coverage

    for r in both.collect():
        points = F.col("norm_points" if r["coordinate_space"] == "norm" else "raw_points")
        polygon = F.array(*[F.struct(F.lit(p["x"]).alias("x"), F.lit(p["y"]).alias("y")) for p in r["polygon"]])
        rows = found.where(F.col("page_id") == r["page_id"]).where(~F.array_contains("quality_flags", "PARTIAL_DATA")).where(F.exists(points, lambda p: p.isNotNull()))
        for x in rows.select("session_id", "stroke_id", coverage(points, polygon).alias("c")).where("c.share >= 0.5").collect():
            alone[x["session_id"], x["stroke_id"]][r["region_id"]] = x["c"]["share"]
    assert together == alone and any(together.values())


def test_a_run_keeps_its_tables(spark):
    run = pipeline.run(pen.pen_points(spark, SF), pen.pen_regions(spark), pen.STROKES, pen.MAPPING, pen.EVENTS)
    assert run.points.inputFiles() and run.strokes.inputFiles() and run.mappings.inputFiles()
