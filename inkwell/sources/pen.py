"""Pen points and page regions: a fixture made of the events table, and readers of canonical records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.config import EventConfig, FeatureConfig, MappingConfig, StrokeConfig
from inkwell.operators.scan import together
from inkwell.operators.wire import EVENT_TYPES

#: Columns that a canonical record must have, and either pair of coordinates.
REQUIRED = ("point_id", "session_id", "page_id", "timestamp_ms", "sequence")
#: The events table's times are hours apart, so its thresholds are.
STROKES = StrokeConfig(max_time_gap_ms=86_400_000, max_spatial_jump_norm=0.3)
MAPPING = MappingConfig()
EVENTS = EventConfig(revision_pause_threshold_ms=43_200_000, process_end_timeout_ms=259_200_000)
FEATURES = FeatureConfig(inside_pause_threshold_ms=21_600_000)
SESSION_END_MS = 1_706_659_200_000


def adapt(records: DataFrame) -> DataFrame:
    """Canonical records as they are; raises if a required column is missing. No other names are guessed."""
    missing = [c for c in REQUIRED if c not in records.columns]
    if missing or not ({"x", "y"} <= {*records.columns} or {"x_raw", "y_raw"} <= {*records.columns}):
        raise ValueError(f"canonical record fields missing: {missing or ['x', 'y']}")
    return records


def read_points(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Canonical records of JSON lines; blank lines are skipped, others must be objects."""
    reader = spark.read.option("mode", "FAILFAST")
    return adapt((reader.schema(schema) if schema else reader).json(path))


def pen_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session per user of the events table, with defects by row number so that every quality flag occurs. Sessions stand together."""
    source = spark.sql(
        """SELECT event_id, user_id, concat('s-', user_id) AS session_id, unix_millis(CAST(ts AS TIMESTAMP)) AS t_ms, day(ts) AS dom, event_type, value,
                 CAST(get_json_object(props, '$.k') AS DOUBLE) AS k
          FROM {events}""",
        events=spark.read.parquet(f"{sf_dir}/events.parquet"),
    )
    return spark.sql(
        """
        WITH e AS (
          SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_id) - 1 AS rn
          FROM {source})
        SELECT session_id, concat('u-', user_id) AS participant_id, concat('seg-', rn div 40) AS task_segment_id,
               CASE WHEN user_id % 5 = 0 THEN NULL ELSE concat('pen-', user_id % 3) END AS device_id,
               CASE WHEN rn % 43 = 42 THEN NULL WHEN rn % 41 = 40 THEN 'page-unknown' ELSE concat('page-', dom div 10) END AS page_id,
               concat('pt-', user_id, '-', CASE WHEN rn % 23 = 22 THEN rn - 1 ELSE rn END) AS point_id,
               CAST(rn AS BIGINT) AS raw_order,
               CAST(CASE WHEN rn % 29 = 28 THEN rn - 2 ELSE rn END AS BIGINT) AS sequence,
               CASE WHEN rn % 31 = 30 THEN NULL ELSE t_ms END AS timestamp_ms,
               CASE WHEN rn % 37 = 36 THEN NULL ELSE value END AS x_raw, k AS y_raw,
               CASE WHEN rn % 19 = 18 THEN NULL ELSE value / 500 END AS x_norm, CASE WHEN rn % 19 = 18 THEN NULL ELSE k / 400 END AS y_norm,
               CASE event_type WHEN 'signup' THEN 'DOWN' WHEN 'purchase' THEN 'UP' WHEN 'error' THEN 'UNKNOWN' ELSE 'MOVE' END AS pen_state
        FROM e""",
        source=together(source, "session_id"),
    )


def pen_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id and participant_id of all points, for what only counts them: no point is shuffled."""
    user = F.col("user_id").cast("string")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("s-"), user).alias("session_id"), F.concat(F.lit("u-"), user).alias("participant_id"))


def region_rows() -> list[tuple[str, str, str, int, list[tuple[float, float]]]]:
    """region_id, page_id, question_id, priority, polygon of the fixture: bands on each page, a triangle on one, a doubled band on another."""
    bands = [("q1", 0.0, 0.06), ("q2", 0.06, 0.12), ("q3", 0.12, 0.3), ("q4", 0.3, 1.0)]
    rows = [(f"r-{p}-{q}", f"page-{p}", q, 0, [(a, 0.0), (b, 0.0), (b, 0.25), (a, 0.25)]) for p in range(4) for q, a, b in bands]
    rows.append(("r-1-q5", "page-1", "q5", 1, [(0.0, 0.0), (0.3, 0.0), (0.15, 0.25)]))
    rows.append(("r-2-q6", "page-2", "q6", 0, [(0.0, 0.0), (0.06, 0.0), (0.06, 0.25), (0.0, 0.25)]))
    return rows


def pen_regions(spark: SparkSession) -> DataFrame:
    schema = "region_id string, page_id string, question_id string, priority int, polygon array<struct<x: double, y: double>>"
    return spark.createDataFrame(region_rows(), schema).withColumn("coordinate_space", F.lit("norm"))


def default_regions(spark: SparkSession) -> DataFrame:
    """Four squares: three on the first page, one on the second."""
    places = [(1, 1, 0.0), (2, 1, 0.2), (3, 1, 0.4), (4, 2, 0.0)]
    rows = [(f"region-q-{q:02d}", f"page-{p:02d}", f"q-{q:02d}", "rectangle", 0, [(x, 0.0), (x + 0.1, 0.0), (x + 0.1, 0.1), (x, 0.1)], "norm") for q, p, x in places]
    return spark.createDataFrame(rows, "region_id string, page_id string, question_id string, region_type string, priority int, polygon array<struct<x: double, y: double>>, coordinate_space string")


def truth_events(points: DataFrame) -> DataFrame:
    """True events of the fixture: one for every 7th point of a session, of that and the next point. Some have no page or no question,
    and every 7th of them names a point that isn't there."""
    n = F.col("raw_order")
    after = F.lead("point_id").over(Window.partitionBy("session_id").orderBy("raw_order"))
    rows = points.withColumn("_after", after).where(n % 7 == 0)
    return rows.select(
        "session_id", F.concat_ws(":truth:", "session_id", n.cast("string")).alias("event_id"), F.get(F.array(*map(F.lit, EVENT_TYPES)), (F.floor(n / 7) % len(EVENT_TYPES)).cast("int")).alias("event_type"),
        F.when(n % 3 > 0, F.col("page_id")).alias("page_id"), F.when(n % 2 == 1, F.concat(F.lit("q"), (n % 4 + 1).cast("string"))).alias("question_id"),
        F.when(n % 49 == 0, F.array(F.lit("none"))).otherwise(F.array_compact(F.array("point_id", "_after"))).alias("source_point_ids"),
    )
