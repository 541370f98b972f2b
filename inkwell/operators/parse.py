"""Canonical records to points: bad values become nulls and flags, and no row is dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.functions.geometry import named
from inkwell.operators.scan import PIECE_ROWS, by_length, by_number, scan, whole

PEN_STATES = ("DOWN", "MOVE", "UP", "UNKNOWN")


def finite(c: Column) -> Column:
    """The number, or null if it isn't one."""
    return F.when(~F.isnan(c) & ~c.isin(float("inf"), float("-inf")), c)


def _or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def _nested(df: DataFrame, name: str, kind: str) -> Column:
    """The field of a struct normalized, where there is one and it isn't null as a whole, else the column of that name."""
    own = _or_null(df, name, kind)
    struct = df.schema["normalized"].dataType if "normalized" in df.columns else None
    if isinstance(struct, T.StructType) and name in struct.names:
        return F.when(F.col("normalized").isNull(), own).otherwise(F.col(f"normalized.{name}").cast(kind))
    return own


def parse_points(records: DataFrame, piece_rows: int = PIECE_ROWS, known: int | None = None, placed: bool = False) -> DataFrame:
    """records with raw_order, the place in a session's input. Flags are in a fixed order. Sessions of more than piece_rows
    points are scanned in pieces of so many places, so none has to fit a task.

    Out of order: behind the last known sequence or time of the same session and page. Duplicate: the id occurs twice in a session.
    known, placed: as in scan.by_length. An empty page counts as missing, though it stays a page of its own. source_index is the input's, if that is a number from 0 on.
    """
    d = records
    x = F.coalesce(finite(_nested(d, "x_raw", "double")), finite(_nested(d, "x", "double")))
    y = F.coalesce(finite(_nested(d, "y_raw", "double")), finite(_nested(d, "y", "double")))
    xn, yn = finite(_or_null(d, "x_norm", "double")), finite(_or_null(d, "y_norm", "double"))
    t = finite(_nested(d, "timestamp_ms", "double"))
    source = _or_null(d, "source_index", "double")
    pen = F.coalesce(_or_null(d, "pen_state_raw", "string"), _or_null(d, "pen_state", "string"))
    rows = d.select(
        F.when(F.coalesce(F.length("point_id"), F.lit(0)) == 0, F.raise_error(F.lit("point_id is missing"))).otherwise(F.col("point_id")).alias("point_id"),
        "session_id",
        *[_or_null(d, c, "string").alias(c) for c in ("participant_id", "task_segment_id", "device_id", "page_id")],
        # All that follows reads raw_order; session_id stays the column by which records may stand together.
        F.when(F.coalesce(F.length("session_id"), F.lit(0)) == 0, F.raise_error(F.lit("session_id is missing")).cast("long")).otherwise(F.col("raw_order").cast("long")).alias("raw_order"),
        finite(F.col("sequence").cast("double")).alias("sequence_payload"),
        F.when(t == F.floor(t), t.cast("long")).alias("timestamp_ms"),
        x.alias("x_raw"),
        y.alias("y_raw"),
        xn.alias("_xn"),
        yn.alias("_yn"),
        F.when(pen.isin(*PEN_STATES), pen).otherwise("UNKNOWN").alias("pen_state"),
        F.when((source >= 0) & (source == F.floor(source)), source.cast("long")).otherwise(F.col("raw_order").cast("long")).alias("source_index"),
    )
    page = F.coalesce(F.concat(F.lit("p"), "page_id"), F.lit("none"))
    rows = rows.withColumns({"_page": page, "_at": F.coalesce("raw_order", F.lit(0))})
    seen = (("session_id", "_page"), ("_at",)), {"last": {"_seq": F.col("sequence_payload"), "_time": F.col("timestamp_ms")}}
    # In the order in which strokes look ids up, so rows are sorted once for both.
    copies = F.count("*").over(Window.partitionBy("session_id", "point_id").orderBy("raw_order").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = by_length(
        rows, "session_id", piece_rows, lambda r: whole(r, *seen[0], **seen[1]).withColumn("_copies", copies),
        lambda r: scan(r.withColumn("_piece", by_number(F.col("_at"), piece_rows)), *seen[0], **seen[1]).drop("_piece").withColumn("_copies", copies), d, known, placed,
    )
    integer = F.col("sequence_payload") == F.floor("sequence_payload")
    bad_norm = (F.col("_xn").isNull() != F.col("_yn").isNull()) | ~F.col("_xn").between(0, 1) | ~F.col("_yn").between(0, 1)
    bad_norm = F.coalesce(bad_norm, F.lit(False)) | (F.col("_xn").isNull() != F.col("_yn").isNull())
    late = F.coalesce(F.col("sequence_payload") < F.col("_seq"), F.lit(False)) | F.coalesce(F.col("timestamp_ms") < F.col("_time"), F.lit(False))
    flags = named(
        F.when(F.col("x_raw").isNull() | F.col("y_raw").isNull(), "INVALID_COORDINATE"),
        F.when(F.col("timestamp_ms").isNull(), "MISSING_TIMESTAMP"),
        F.when(F.coalesce(F.length("page_id"), F.lit(0)) == 0, "MISSING_PAGE"),
        F.when(F.col("_copies") > 1, "DUPLICATE_POINT"),
        F.when(F.col("sequence_payload").isNull(), "MISSING_SEQUENCE"),
        F.when(late, "OUT_OF_ORDER"),
        F.when(bad_norm, "INVALID_NORM_COORDINATE"),
    )
    return rows.select(
        "point_id", "session_id", "participant_id", "task_segment_id", "device_id", "page_id",
        F.coalesce(F.when(integer, F.col("sequence_payload").cast("long")), F.col("raw_order")).alias("sequence"),
        "sequence_payload", "timestamp_ms", "x_raw", "y_raw",
        F.when(~bad_norm, F.col("_xn")).alias("x_norm"),
        F.when(~bad_norm, F.col("_yn")).alias("y_norm"),
        "pen_state", "source_index", "raw_order", flags.alias("quality_flags"),
    )


def eligible(points: DataFrame) -> DataFrame:
    """Points that may be exported: device, page, time and raw coordinates are known."""
    return points.where("device_id IS NOT NULL AND page_id IS NOT NULL AND timestamp_ms IS NOT NULL AND x_raw IS NOT NULL AND y_raw IS NOT NULL")
