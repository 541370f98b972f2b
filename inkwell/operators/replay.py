"""Page replay: points in reading order with the stroke they belong to, and the pages in order of first sight."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replay_frames(points: DataFrame, strokes: DataFrame) -> DataFrame:
    """A frame per point: by time, then payload sequence (unknown ones last), then source place. A point id in several strokes goes to the first."""
    owners = strokes.select("session_id", F.explode("point_refs").alias("point_id"), "stroke_index", "stroke_id").groupBy("session_id", "point_id").agg(F.min_by("stroke_id", "stroke_index").alias("stroke_id"))
    copies = F.count("*").over(Window.partitionBy("session_id", "point_id"))
    order = Window.partitionBy("session_id").orderBy(F.asc_nulls_last("timestamp_ms"), F.asc_nulls_last("sequence_payload"), "source_index", "raw_order")
    rows = points.withColumn("_copies", copies).join(owners, ["session_id", "point_id"], "left")
    flags = F.array_distinct(F.array_compact(F.concat("quality_flags", F.array(F.when(F.col("_copies") > 1, "DUPLICATE_SOURCE_ID")))))
    return rows.select("session_id", (F.row_number().over(order) - 1).cast("long").alias("frame_index"), "point_id", "stroke_id", "page_id", "timestamp_ms", "x_norm", "y_norm", flags.alias("quality_flags"))


def page_order(frames: DataFrame) -> DataFrame:
    """session_id, page_id, first_frame, place: pages by the first frame that shows them."""
    pages = frames.where("page_id IS NOT NULL").groupBy("session_id", "page_id").agg(F.min("frame_index").alias("first_frame"))
    return pages.withColumn("place", (F.row_number().over(Window.partitionBy("session_id").orderBy("first_frame")) - 1).cast("long"))
