"""Strokes: gaps and islands over a session's points in input order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.config import StrokeConfig
from inkwell.functions.geometry import named, numbered
from inkwell.operators.scan import PIECE_ROWS, by_length, by_number, scan, whole

#: Version of the stroke rules that every stroke carries.
VERSION = "inkwell-stroke-1"
CONTEXT = ("participant_id", "task_segment_id", "page_id", "device_id")
_INCOMPLETE = ("INVALID_COORDINATE", "MISSING_TIMESTAMP", "MISSING_PAGE", "MISSING_SEQUENCE")
_PARTIAL = ("DUPLICATE_POINT", "OUT_OF_ORDER")


def with_stroke_index(points: DataFrame, config: StrokeConfig | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """points with stroke_index, and lengths norm_step and raw_step from the point before in the same stroke.

    A new stroke begins where the context changes, where the time or the normalised distance from the point before is too
    large (unknown ones aren't), or where the pen comes down after it was up. Who wrote the point before doesn't matter, so the
    scan is over a session, in pieces of piece_rows places if it has more points than that.
    """
    return by_length(points, "session_id", piece_rows, *_indexed(config, piece_rows)).drop("_back", "_starts")


def _indexed(config: StrokeConfig | None, piece_rows: int) -> tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]]:
    """Functions that number the strokes of sessions that a task holds, and of others. _starts: whether a point is its stroke's first. _back:
    whether its place by time is before that of the point before it in its stroke."""
    c = config or StrokeConfig()
    in_pieces = lambda r: r.withColumn("_piece", by_number(F.col("raw_order"), piece_rows))
    return lambda r: _with_index(r, c, whole), lambda r: _with_index(in_pieces(r), c, scan).drop("_piece")


def _with_index(rows: DataFrame, c: StrokeConfig, scan: Callable[..., DataFrame]) -> DataFrame:
    before = (*CONTEXT, "timestamp_ms", "x_norm", "y_norm", "x_raw", "y_raw", "pen_state", "raw_order", "sequence_payload", "source_index")
    rows = scan(rows, ("session_id",), ("raw_order",), lag={f"_{k}": F.col(k) for k in before})
    same = F.lit(True)
    for k in CONTEXT:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    near_in_time = F.coalesce(F.abs(F.col("timestamp_ms") - F.col("_timestamp_ms")) <= c.max_time_gap_ms, F.lit(True))
    step = F.hypot(F.col("x_norm") - F.col("_x_norm"), F.col("y_norm") - F.col("_y_norm"))
    near_in_space = F.coalesce(step <= c.max_spatial_jump_norm, F.lit(True))
    down = (F.col("pen_state") == "DOWN") & (F.col("_pen_state") == "UP") if c.use_pen_state else F.lit(False)
    starts = F.col("_raw_order").isNull() | ~same | ~near_in_time | ~near_in_space | F.coalesce(down, F.lit(False))
    raw = F.hypot(F.col("x_raw") - F.col("_x_raw"), F.col("y_raw") - F.col("_y_raw"))
    rows = rows.withColumn("_starts", starts).withColumn("norm_step", F.when(~F.col("_starts"), step)).withColumn("raw_step", F.when(~F.col("_starts"), raw))
    place = lambda mark: F.struct(f"{mark}timestamp_ms", F.coalesce(f"{mark}sequence_payload", F.lit(float("inf"))), f"{mark}source_index", f"{mark}raw_order")
    rows = rows.withColumn("_back", ~F.col("_starts") & (place("") < place("_"))).drop(*[f"_{k}" for k in before])
    return scan(rows, ("session_id",), ("raw_order",), total={"stroke_index": F.col("_starts").cast("long")})


def build_strokes(points: DataFrame, config: StrokeConfig | None = None, piece_rows: int = PIECE_ROWS, known: int | None = None, placed: bool = False) -> DataFrame:
    """A row per stroke, with its points' coordinates and times in processed order for the operators that follow. known, placed: as in
    scan.by_length."""
    short, long = _indexed(config, piece_rows)
    return by_length(points, "session_id", piece_rows, lambda r: _built(short(_looked_up(r))), lambda r: _built(long(_looked_up(r))), known=known, placed=placed)


def _known() -> Column:
    """What operators that look points up by id get."""
    side = lambda s: F.when(F.col(f"x_{s}").isNotNull() & F.col(f"y_{s}").isNotNull(), F.struct(F.col(f"x_{s}").alias("x"), F.col(f"y_{s}").alias("y"))).alias(s)
    return F.struct(side("norm"), side("raw"), "timestamp_ms", "quality_flags")


def _looked_up(rows: DataFrame) -> DataFrame:
    """rows with _other: of points of one id, what the last of them says; null where a point is alone."""
    same_id = Window.partitionBy("session_id", "point_id").orderBy("raw_order").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"_last": F.last(_known()).over(same_id), "_same": F.count("*").over(same_id)})
    # raw_order stays as it is. That it names this window keeps Spark from sorting by it first, and then by id and by it again.
    there = {"_other": F.when(F.col("_same") > 1, F.col("_last")), "raw_order": F.when(F.col("_same") > 0, F.col("raw_order"))}
    return rows.withColumns(there).drop("_last", "_same")


def _built(rows: DataFrame) -> DataFrame:
    """A row for each stroke, in the place of its first point: a window over a stroke's points needs no second table of groups."""
    usable_norm, usable_raw = F.col("x_norm").isNotNull() & F.col("y_norm").isNotNull(), F.col("x_raw").isNotNull() & F.col("y_raw").isNotNull()
    usable = usable_norm | usable_raw
    point = F.struct("raw_order", "timestamp_ms", F.coalesce("sequence_payload", F.lit(float("inf"))).alias("seq"), "source_index", "point_id", F.coalesce("_other", _known()).alias("found"), "quality_flags")
    box = {f"{f}_{c}": getattr(F, f)(F.when(usable_norm if c.endswith("norm") else usable_raw, F.col(c))) for f in ("min", "max") for c in ("x_norm", "y_norm", "x_raw", "y_raw")}
    own = Window.partitionBy("session_id", "stroke_index").orderBy("raw_order").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    made = {
        "inputs": F.collect_list(point),
        "start_time_ms": F.min("timestamp_ms"),
        "end_time_ms": F.max("timestamp_ms"),
        "_untimed": F.bool_or(F.col("timestamp_ms").isNull()),
        "_unsorted": F.bool_or("_back"),
        "_any": F.bool_or(usable),
        "_all_norm": F.bool_and(~usable | usable_norm),
        "_all_raw": F.bool_and(~usable | usable_raw),
        "n_points": F.count("*"),
        "_norm_length": F.sum("norm_step"),
        "_has_norm": F.bool_or(usable_norm),
        **{f"_{k}": v for k, v in box.items()},
    }
    found = rows.withColumns({k: v.over(own) for k, v in made.items()}).where("_starts").withColumn("inputs", F.sort_array("inputs"))
    space = F.when(F.col("_any") & F.col("_all_norm"), "norm").when(F.col("_any") & F.col("_all_raw"), "raw").otherwise("unavailable")
    side = lambda k: F.when(F.col("space") == "norm", F.col(f"_{k}_norm")).when(F.col("space") == "raw", F.col(f"_{k}_raw")).otherwise(0.0)
    flags = F.array_distinct(F.flatten("inputs.quality_flags"))
    by_time = F.transform(F.sort_array(F.transform("inputs", lambda p: F.struct(p["timestamp_ms"].alias("t"), p["seq"].alias("s"), p["source_index"].alias("i"), p["raw_order"].alias("o"), p.alias("p")))), lambda s: s["p"])
    return (
        found.withColumn("space", space)
        .withColumn("pts", F.when(F.col("_untimed") | ~F.col("_unsorted"), F.col("inputs")).otherwise(by_time))
        .withColumn("_flags", flags)
        .select(
            "session_id",
            "stroke_index",
            numbered("stroke-", F.col("stroke_index")).alias("stroke_id"),
            *CONTEXT,
            "n_points",
            "start_time_ms",
            "end_time_ms",
            (F.col("end_time_ms") - F.col("start_time_ms")).alias("duration_ms"),
            F.col("inputs.point_id").alias("point_refs"),
            F.col("pts.point_id").alias("processed_order"),
            F.col("space").alias("bbox_space"),
            F.struct(side("min_x").alias("x"), side("min_y").alias("y"), (side("max_x") - side("min_x")).alias("width"), (side("max_y") - side("min_y")).alias("height")).alias("bbox"),
            F.when(F.col("n_points") == 1, F.when(F.col("_has_norm"), 0.0)).otherwise(F.col("_norm_length")).alias("path_length_norm"),
            named(F.when(F.arrays_overlap("_flags", F.array(*map(F.lit, _INCOMPLETE))), "INCOMPLETE"), F.when(F.arrays_overlap("_flags", F.array(*map(F.lit, _PARTIAL))), "PARTIAL_DATA")).alias("quality_flags"),
            F.lit(VERSION).alias("algorithm_version"),
            F.array_distinct(F.flatten("pts.found.quality_flags")).alias("point_flags"),
            F.col("pts.found.norm").alias("norm_points"),
            F.col("pts.found.raw").alias("raw_points"),
            F.col("pts.found.timestamp_ms").alias("times"),
        )
    )
