"""Ink boxes that an earlier box of the same group overlaps, by a grid index.

Two boxes of intersection over union t or more have widths, and heights, within a factor of 1 / t of each other, and meet in area. So
each box has a size class on each axis, powers of 4, and stands in the cells of its own and the next larger classes within that factor;
a cell of the larger class of the two then holds both. Boxes are joined by cell and time as a semi join: it ends at the first earlier
box that overlaps and never gathers what came before.

Equal boxes overlap whatever their size, so of equal ones the earliest stands in the grid, and equal ones are found by a join of their own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.geometry import overlap

BASE = 4
#: Sizes below are of one class, as far as the grid goes.
LEAST = 1e-9


def _class(size: Column) -> Column:
    """A class whose cells are wider than the size."""
    return (F.floor(F.log(F.greatest(size, F.lit(LEAST))) / math.log(BASE)) + 1).cast("int")


def _cells(low: Column, high: Column, own: Column, wider: int) -> Column:
    """Array of (level, cell) of a side in its own and the wider classes."""
    levels = F.sequence(own, own + wider)
    side = lambda k: F.pow(F.lit(float(BASE)), k)
    return F.flatten(F.transform(levels, lambda k: F.transform(F.sequence(F.floor(low / side(k)).cast("long"), F.floor(high / side(k)).cast("long")), lambda c: F.struct(k.alias("level"), c.alias("cell")))))


def touched(marks: DataFrame, group: Sequence[str], threshold: float) -> DataFrame:
    """The marks that an earlier one of their group that writes overlaps by threshold or more (as intersection over union).

    marks: the group's columns (not null), box (left, top, right, bottom), at (what orders them), writes.
    """
    stored = marks.where("writes").groupBy(*group, "box").agg(F.min("at").alias("first"))
    if threshold <= 0:
        first = stored.groupBy(*group).agg(F.min("first").alias("first"))
        return marks.join(first, list(group)).where("first < at").drop("first")
    equal = marks.join(stored, [*group, "box"]).where("first < at").drop("first")
    wider = math.ceil(math.log(1 / threshold) / math.log(BASE) + 1e-9)
    flat = (F.col("box.right") <= F.col("box.left")) | (F.col("box.bottom") <= F.col("box.top"))  # without area only equal ones overlap

    def gridded(df: DataFrame) -> DataFrame:
        df = df.where(~flat).withColumns({"_cx": _class(F.col("box.right") - F.col("box.left")), "_cy": _class(F.col("box.bottom") - F.col("box.top"))})
        across, down = _cells(F.col("box.left"), F.col("box.right"), F.col("_cx"), wider), _cells(F.col("box.top"), F.col("box.bottom"), F.col("_cy"), wider)
        return df.withColumn("_x", F.explode(across)).withColumn("_y", F.explode(down))

    q = gridded(marks)
    keys = [*group, "_x", "_y"]
    there = gridded(stored).select(*keys, F.col("box").alias("_box"), "first", F.col("_cx").alias("_ox"), F.col("_cy").alias("_oy")).alias("s")
    on = None
    for k in keys:
        on = (F.col(f"q.{k}") == F.col(f"s.{k}")) if on is None else on & (F.col(f"q.{k}") == F.col(f"s.{k}"))
    # A pair meets in the cells of the larger class of the two.
    larger = (F.col("q._x.level") == F.greatest("q._cx", "s._ox")) & (F.col("q._y.level") == F.greatest("q._cy", "s._oy"))
    near = q.alias("q").join(there, on & larger & (F.col("s.first") < F.col("q.at")) & (overlap(F.col("q.box"), F.col("s._box"), 1.0) >= threshold), "left_semi")
    return equal.unionByName(near.drop("_cx", "_cy", "_x", "_y")).distinct()
