"""Strokes to page regions by the share of their length inside.

Each page has a grid; strokes and regions whose boxes share a cell and meet are candidates, and only those are clipped, so a page may
have any number of regions. Where no page has more than a few, a page's regions are a list that all its strokes are compared with, and
strokes stay where they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.config import MappingConfig
from inkwell.functions.geometry import NEAR, TINY, complete, extent, extent_sides, let, line, named, point_inside, shape, shape_coverage, some


#: Cells of a page's grid on each side at most.
MOST_CELLS = 256
#: Regions of a page at most, and of all pages, that are compared without a grid and known to all tasks.
FEW, KNOWN = 64, 50_000
_BOX = ("left", "top", "right", "bottom")


def _space() -> Column:
    return F.when(F.col("coordinate_space") == "norm", "norm").otherwise("raw").alias("_space")


def _extent(points: Column) -> Column:
    """The box of the known points; null if there is none."""
    return F.when(some(points), extent(points, _BOX))


def _grid(regions: DataFrame) -> DataFrame:
    """page_id, _space, and the corner, cells and cell sizes of a grid with about as many cells as the page has regions, none smaller than
    a region is on average. regions: with box."""
    b = lambda k: F.col(f"box.{k}")
    grid = regions.groupBy("page_id", "_space").agg(
        F.min(b("left")).alias("x0"), F.min(b("top")).alias("y0"), F.max(b("right")).alias("x1"), F.max(b("bottom")).alias("y1"),
        F.least(F.ceil(F.sqrt(F.count("*"))), F.lit(MOST_CELLS)).alias("cells"), F.avg(b("right") - b("left")).alias("w"), F.avg(b("bottom") - b("top")).alias("h"),
    )
    size = lambda low, high, mean: F.greatest((F.col(high) - F.col(low)) / F.col("cells"), F.col(mean), F.lit(NEAR))
    return grid.select("page_id", "_space", "x0", "y0", "cells", size("x0", "x1", "w").alias("sx"), size("y0", "y1", "h").alias("sy"))


def _celled(rows: DataFrame) -> DataFrame:
    """A row for each cell (ix, iy) that a row's box covers, and its first cells. rows: with the page's grid."""
    at = lambda k, low, size: F.least(F.greatest(F.floor((F.col(f"box.{k}") - F.col(low)) / F.col(size)).cast("long"), F.lit(0)), F.col("cells"))
    rows = rows.withColumns({"fx": at("left", "x0", "sx"), "fy": at("top", "y0", "sy"), "lx": at("right", "x0", "sx"), "ly": at("bottom", "y0", "sy")})
    return rows.withColumn("ix", F.explode(F.sequence("fx", "lx"))).withColumn("iy", F.explode(F.sequence("fy", "ly"))).drop("x0", "y0", "cells", "sx", "sy", "lx", "ly")


def _wider() -> Column:
    """The box of a region, wider by as much as a point may miss it."""
    box = _extent(F.col("polygon"))
    return F.when(box.isNotNull(), F.struct(*[(box[n] + d).alias(n) for n, d in zip(_BOX, (-NEAR, -NEAR, NEAR, NEAR), strict=True)]))


def _region() -> Column:
    """What strokes need of a region. Its box stands apart, so that it's compared without looking into the shape."""
    norm = F.coalesce(F.col("coordinate_space") == "norm", F.lit(False)).alias("norm")
    made = F.when(F.size("polygon") > 0, shape(F.col("polygon")))
    return let(made, lambda s: F.struct("region_id", "question_id", "priority", norm, s.alias("shape"), *[s["box"][k].alias(k) for k in _BOX]))


def _meet(a: Column | dict[str, Column], b: Column) -> Column:
    return (a["left"] <= b["right"]) & (b["left"] <= a["right"]) & (a["top"] <= b["bottom"]) & (b["top"] <= a["bottom"])


def _pages(regions: DataFrame, *also: Column) -> DataFrame:
    """page_id, whether it has regions that see normalised or raw coordinates, or are measured in these, and what is also wanted."""
    norm = F.col("coordinate_space") == "norm"
    known = F.coalesce(norm, F.lit(False))
    return regions.groupBy("page_id").agg(F.bool_or(norm).alias("_sees_norm"), F.bool_or(~norm).alias("_sees_raw"), F.bool_or(known).alias("_in_norm"), F.bool_or(~known).alias("_in_raw"), *also)


def _listed(strokes: DataFrame, regions: DataFrame) -> DataFrame:
    """strokes with regions, by lists of the pages' regions, and what _pages says of their page."""
    lists = _pages(regions.withColumn("_r", _region()), F.collect_list("_r").alias("_there"))
    near = F.filter("_there", lambda r: F.when(r["norm"], _meet(_own_box("norm"), r)).otherwise(_meet(_own_box("raw"), r)))
    rows = _boxed(strokes.join(F.broadcast(lists), "page_id", "left"))
    return rows.withColumn("regions", F.when(~F.array_contains("quality_flags", "PARTIAL_DATA"), near)).drop("_there")


def _boxed(rows: DataFrame) -> DataFrame:
    """Strokes with their boxes in the spaces in which their page has regions, as plain columns."""
    return rows.withColumns({f"_{n}_{k}": F.when(F.col(f"_in_{n}"), b) for n in ("norm", "raw") for k, b in zip(_BOX, extent_sides(F.col(f"{n}_points")), strict=True)})


def _own_box(n: str) -> dict[str, Column]:
    return {k: F.col(f"_{n}_{k}") for k in _BOX}


def near_regions(strokes: DataFrame, regions: DataFrame) -> DataFrame:
    """session_id, stroke_index, regions: those of its page whose box meets the stroke's, by the cells of a grid on each page."""
    placed = regions.withColumn("_space", _space()).withColumn("box", _wider())
    grid = _grid(placed)
    there = _celled(placed.select("page_id", "_space", "box", _region().alias("region")).join(grid, ["page_id", "_space"]))
    there = there.select("page_id", "_space", "ix", "iy", "region", F.col("box").alias("_box"), F.col("fx").alias("_fx"), F.col("fy").alias("_fy"))
    sides = F.array(*[F.struct(F.lit(n).alias("_space"), _extent(F.col(f"{n}_points")).alias("box")) for n in ("norm", "raw")])
    ours = strokes.where(~F.array_contains("quality_flags", "PARTIAL_DATA")).select("session_id", "stroke_index", "page_id", F.explode(sides).alias("_side"))
    ours = ours.select("session_id", "stroke_index", "page_id", "_side.*").where("box IS NOT NULL")
    ours = _celled(ours.join(grid, ["page_id", "_space"]))
    meet = _meet(F.col("box"), F.col("_box"))
    # Of the cells that both have, a pair meets in the first.
    once = (F.col("ix") == F.greatest("fx", "_fx")) & (F.col("iy") == F.greatest("fy", "_fy"))
    pairs = ours.join(there, ["page_id", "_space", "ix", "iy"]).where(meet & once)
    return pairs.groupBy("session_id", "stroke_index").agg(F.collect_list("region").alias("regions"))


def listed(regions: DataFrame) -> bool:
    """Whether pages have so few regions that strokes are compared with lists of them; strokes are then read once."""
    count = regions.groupBy("page_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    return (count["most"] or 0) <= FEW and (count["all"] or 0) <= KNOWN


def candidates(strokes: DataFrame, regions: DataFrame, config: MappingConfig, few: bool | None = None) -> DataFrame:
    """strokes with best (array of candidates, best first) and seen: whether a region of the page saw a coordinate. few: what listed says.
    If it isn't so, strokes are read twice, and it is best if they are a written table."""

    def measured(lines, r):
        c = let(F.when(r["norm"], lines["norm"]).otherwise(lines["raw"]), lambda x: shape_coverage(x, r["shape"]))
        return let(c, lambda x: as_best(x["share"], r, x["method"]))

    def as_best(share, r, method):
        return F.struct(share.alias("coverage"), r["priority"].alias("priority"), r["region_id"].alias("region_id"), r["question_id"].alias("question_id"), method.alias("method"))

    def measured_point(r):
        # A point is the corner of its own box.
        inside = [point_inside(F.col(f"_{n}_left"), F.col(f"_{n}_top"), r["shape"]) for n in ("norm", "raw")]
        return as_best(F.when(F.when(r["norm"], inside[0]).otherwise(inside[1]), 1.0).otherwise(0.0), r, F.lit("POINT_FALLBACK"))

    unusable = F.array_contains("quality_flags", "PARTIAL_DATA") | F.col("page_id").isNull()
    few = listed(regions) if few is None else few
    rows = _listed(strokes, regions) if few else _boxed(strokes.join(near_regions(strokes, regions), ["session_id", "stroke_index"], "left").join(_pages(regions), "page_id", "left"))
    # A stroke's lines are made once for all its regions; strokes of one point have none.
    in_space = lambda n: F.when(F.col(f"_in_{n}"), line(F.col(f"{n}_points"))).alias(n)
    every = let(F.struct(in_space("norm"), in_space("raw")), lambda lines: F.transform("regions", lambda r: measured(lines, r)))
    every = F.when(F.size("norm_points") == 1, F.transform("regions", measured_point)).otherwise(every)
    rows = rows.withColumn("_all", F.when(F.size("regions") > 0, every).otherwise(F.array())).drop("regions")
    best = F.sort_array(F.filter("_all", lambda m: m["coverage"] >= config.min_coverage), asc=False)
    seen = F.coalesce((F.col("_sees_norm") & some(F.col("norm_points"))) | (F.col("_sees_raw") & some(F.col("raw_points"))), F.lit(False))
    return rows.withColumn("best", best).withColumn("seen", seen).withColumn("unusable", unusable).drop("_all", "_sees_norm", "_sees_raw", "_in_norm", "_in_raw", *[f"_{n}_{k}" for n in ("norm", "raw") for k in _BOX])


def map_strokes(strokes: DataFrame, regions: DataFrame, config: MappingConfig | None = None, also: Sequence[str] = (), few: bool | None = None) -> DataFrame:
    """A mapping per stroke: MAPPED, UNKNOWN or AMBIGUOUS; the columns that events and features need are carried along, and so are those
    named in also. few: what listed says of the regions, where that is known."""
    c = config or MappingConfig()
    rows = candidates(strokes, regions, c, few)
    first, second = F.get("best", F.lit(0)), F.get("best", F.lit(1))
    ambiguous = F.coalesce((F.abs(first["coverage"] - second["coverage"]) <= c.ambiguity_epsilon) & (first["priority"] == second["priority"]), F.lit(False))
    status = F.when(F.col("unusable") | (F.size("best") == 0), "UNKNOWN").when(ambiguous, "AMBIGUOUS").otherwise("MAPPED")
    flags = (
        F.when(F.col("unusable"), F.array_distinct(F.concat("quality_flags", named(F.when(F.col("page_id").isNull(), "MISSING_PAGE")))))
        .when(F.size("best") == 0, F.array(F.when(F.col("seen"), "NO_REGION_MATCH").otherwise("NO_NORMALIZED_COORDINATES")))
        .when(ambiguous, F.array(F.lit("AMBIGUOUS_REGION")))
        .otherwise(F.array_distinct("quality_flags"))
    )
    rows = rows.withColumn("status", status)
    mapped = F.col("status") == "MAPPED"
    return rows.select(
        "session_id", "stroke_index", "stroke_id", "participant_id", "task_segment_id", "page_id", "device_id",
        F.when(mapped, first["question_id"]).alias("question_id"),
        F.when(mapped, first["region_id"]).alias("region_id"),
        "status",
        F.when(mapped, first["coverage"]).alias("confidence"),
        F.when(mapped, first["method"]).otherwise("UNKNOWN").alias("mapping_method"),
        "start_time_ms", "end_time_ms", "point_refs", flags.alias("quality_flags"), "norm_points", "raw_points", "times",
        F.col("quality_flags").alias("stroke_flags"), "point_flags", "bbox", "bbox_space", *also,
    )


def writing_evidence():
    """Whether a stroke's points, two or more, all have normalised (else raw) coordinates and a length."""

    def long(points):
        n = F.size(points)
        pairs = F.zip_with(F.slice(points, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
        # A line is at least as long as its box.
        wide = F.coalesce(F.greatest(*[F.array_max(points[k]) - F.array_min(points[k]) for k in "xy"]) > 2 * TINY, F.lit(False))
        return F.forall(points, lambda p: p.isNotNull()) & (wide | (F.aggregate(pairs, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))) > TINY))

    return (F.size("norm_points") >= 2) & (long(F.col("norm_points")) | long(F.col("raw_points")))


def ink_box():
    """Box of all points in normalised, else raw coordinates, with its space and domain; null if neither is complete."""
    whole = lambda p: (F.size(p) > 0) & complete(p)
    domain = F.coalesce(F.concat(F.lit("device:"), F.col("device_id")), F.lit("unknown"))
    made = lambda p, space, where: F.struct(extent(p).alias("box"), F.lit(space).alias("space"), where.alias("domain"))
    return F.when(whole(F.col("norm_points")), made(F.col("norm_points"), "norm", F.lit("norm"))).when(whole(F.col("raw_points")), made(F.col("raw_points"), "raw", domain))


__all__ = ["candidates", "ink_box", "let", "map_strokes", "writing_evidence"]
