"""Geometry as column expressions: containment, clipping at polygons, overlap of boxes. Polygons are arrays of structs (x, y)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEAR, TINY = 1e-9, 1e-12


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def named(*flags: Column) -> Column:
    """Array of those flags that aren't null. Unlike array_compact, this and all below it is compiled; no flag is empty."""
    return F.array_remove(F.array(*[F.coalesce(f, F.lit("")) for f in flags]), "")


def numbered(prefix: str | Column, number: Column) -> Column:
    """The prefix and the number, which isn't negative, with four digits at least; format_string is several times as slow."""
    text = number.cast("string")
    return F.concat(F.lit(prefix) if isinstance(prefix, str) else prefix, F.when(number < 10_000, F.lpad(text, 4, "0")).otherwise(text))


def some(points: Column) -> Column:
    """Whether any point is known; compiled, unlike lambdas."""
    return F.array_max(points).isNotNull()


def complete(points: Column) -> Column:
    """Whether all points, or all numbers, are known. Lists of one, as most strokes have, need no lambda."""
    return F.when(F.size(points) == 1, F.get(points, F.lit(0)).isNotNull()).otherwise(F.forall(points, lambda p: p.isNotNull()))


def extent(points: Column, names: tuple[str, str, str, str] = ("left", "top", "right", "bottom")) -> Column:
    """The box of the known points; its sides are null if there is none."""
    return F.struct(*[side.alias(n) for n, side in zip(names, extent_sides(points), strict=True)])


def extent_sides(points: Column) -> list[Column]:
    return [f(points[k]) for f, k in zip((F.array_min, F.array_min, F.array_max, F.array_max), "xyxy", strict=True)]


def edges(polygon: Column) -> Column:
    """Array of structs (a, b): the sides of the polygon."""
    n = F.size(polygon)
    turned = F.concat(F.slice(polygon, F.lit(2), n - 1), F.slice(polygon, F.lit(1), F.lit(1)))
    return F.zip_with(polygon, turned, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def contains(x: Column, y: Column, sides: Column) -> Column:
    """Whether the point is inside by the even-odd rule, or on a side."""

    def on(e: Column) -> Column:
        a, b = e["a"], e["b"]
        cross = (x - a["x"]) * (b["y"] - a["y"]) - (y - a["y"]) * (b["x"] - a["x"])
        return (F.abs(cross) <= NEAR) & x.between(F.least(a["x"], b["x"]) - NEAR, F.greatest(a["x"], b["x"]) + NEAR) & y.between(F.least(a["y"], b["y"]) - NEAR, F.greatest(a["y"], b["y"]) + NEAR)

    def crossed(e: Column) -> Column:
        a, b = e["a"], e["b"]
        straddles = (a["y"] > y) != (b["y"] > y)
        return F.when(straddles, x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]).otherwise(False)

    return F.exists(sides, on) | (F.size(F.filter(sides, crossed)) % 2 == 1)


def cuts(p: Column, q: Column, side: Column) -> Column:
    """Parameters (0 at p, 1 at q) where the segment meets the side; both ends of the side if it lies along it."""
    rx, ry = q["x"] - p["x"], q["y"] - p["y"]
    a, b = side["a"], side["b"]
    sx, sy = b["x"] - a["x"], b["y"] - a["y"]
    dx, dy = a["x"] - p["x"], a["y"] - p["y"]
    det = rx * sy - ry * sx
    rr = rx * rx + ry * ry
    none = F.array().cast("array<double>")
    along = F.when((F.abs(dx * ry - dy * rx) > TINY) | (rr <= TINY), none).otherwise(F.array((dx * rx + dy * ry) / rr, ((b["x"] - p["x"]) * rx + (b["y"] - p["y"]) * ry) / rr))
    t, u = (dx * sy - dy * sx) / det, (dx * ry - dy * rx) / det
    met = F.when(t.between(-TINY, 1 + TINY) & u.between(-TINY, 1 + TINY), F.array(t)).otherwise(none)
    return F.when(F.abs(det) <= TINY, along).otherwise(met)


def bounds(sides: Column) -> Column:
    """The polygon's box, wider by as much as a point may miss a side."""
    at = lambda k: sides["a"][k]
    return F.struct(*[(f(at(k)) + d).alias(n) for n, f, k, d in (("left", F.array_min, "x", -NEAR), ("right", F.array_max, "x", NEAR), ("top", F.array_min, "y", -NEAR), ("bottom", F.array_max, "y", NEAR))])


def apart(p: Column, q: Column, box: Column) -> Column:
    """Whether the segment passes the box by on one side."""
    beside = lambda k, low, high: ((p[k] < box[low]) & (q[k] < box[low])) | ((p[k] > box[high]) & (q[k] > box[high]))
    return beside("x", "left", "right") | beside("y", "top", "bottom")


def inside_length(p: Column, q: Column, sides: Column) -> Column:
    """Length of the segment's part inside the polygon."""
    length = F.hypot(q["x"] - p["x"], q["y"] - p["y"])
    clamp = lambda t: F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    marks = F.array_sort(F.array_distinct(F.transform(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.flatten(F.transform(sides, lambda e: cuts(p, q, e)))), clamp)))

    def total(m: Column) -> Column:
        n = F.size(m)
        spans = F.zip_with(F.slice(m, F.lit(1), n - 1), F.slice(m, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

        def part(s: Column) -> Column:
            mid = (s["a"] + s["b"]) / 2
            return F.when((s["b"] - s["a"] > TINY) & contains(p["x"] + mid * (q["x"] - p["x"]), p["y"] + mid * (q["y"] - p["y"]), sides), (s["b"] - s["a"]) * length).otherwise(0.0)

        return F.aggregate(spans, F.lit(0.0), lambda acc, s: acc + part(s))

    return F.when(length <= TINY, 0.0).otherwise(let(marks, total))


def shape(polygon: Column) -> Column:
    """What coverage needs of a polygon: its sides, box, planes if it is convex, and itself as a box if it is a rectangle along the axes."""
    made = let(edges(polygon), lambda e: F.struct(e.alias("sides"), bounds(e).alias("box"), planes(e).alias("planes")))
    straight = lambda s: (F.size(s) == 4) & F.forall(s, lambda e: (e["a"]["x"] == e["b"]["x"]) | (e["a"]["y"] == e["b"]["y"]))
    return let(made, lambda m: F.struct(*[m[k].alias(k) for k in ("sides", "box", "planes")], F.when(m["planes"].isNotNull() & straight(m["sides"]), extent(m["sides"]["a"])).alias("rect")))


def planes(sides: Column) -> Column:
    """Array of structs (x, y, c), one for each side: x * px + y * py + c is 0 on its line and positive on the inner side. Null if the
    polygon isn't convex, has no area or goes round more than once."""
    corners = F.transform(sides, lambda e: e["a"])
    area = F.aggregate(sides, F.lit(0.0), lambda acc, e: acc + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])

    def plane(e: Column, turn: Column) -> Column:
        x, y = turn * (e["a"]["y"] - e["b"]["y"]), turn * (e["b"]["x"] - e["a"]["x"])
        return F.struct(x.alias("x"), y.alias("y"), (-(x * e["a"]["x"] + y * e["a"]["y"])).alias("c"))

    once = F.size(F.array_distinct(corners)) == F.size(F.filter(sides, lambda e: e["a"] != e["b"]))
    all_inside = lambda p: F.forall(p, lambda s: F.forall(corners, lambda v: beyond(v, s) >= -TINY))
    made = let(F.signum(area), lambda turn: F.transform(sides, lambda e: plane(e, turn)))
    return F.when((F.abs(area) > TINY) & once, let(made, lambda p: F.when(all_inside(p), p)))


def beyond(p: Column, plane: Column) -> Column:
    """How far the point is on the inner side of a plane, in lengths of its side."""
    return plane["x"] * p["x"] + plane["y"] * p["y"] + plane["c"]


def convex_share(p: Column, q: Column, planes: Column) -> Column:
    """Share of the segment inside a convex polygon, from the last side it comes in by to the first it leaves by. As in contains, what lies
    along a side is inside: the middle of what is outside is compared."""

    ends = lambda s: (beyond(p, s), beyond(q, s))
    span = F.coalesce(F.array_min(F.transform(planes, lambda s: _leaves(*ends(s)))), F.lit(1.0)) - F.coalesce(F.array_max(F.transform(planes, lambda s: _enters(*ends(s)))), F.lit(0.0))
    return let(span, lambda d: F.when(d > TINY, d).otherwise(0.0))


def _enters(a: Column, b: Column) -> Column:
    """Where a segment whose ends are so far on a side's inner side comes in."""
    return F.when(a < 0, F.when(b >= 0, F.when(a < -2 * NEAR, a / (a - b))).when(a + b < -2 * NEAR, 2.0))


def _leaves(a: Column, b: Column) -> Column:
    return F.when(b < -2 * NEAR, F.when(a >= 0, a / (a - b)))


def rectangle_share(p: Column, q: Column, box: Column) -> Column:
    """convex_share of a rectangle along the axes, without a list of its sides."""
    width, height = box["right"] - box["left"], box["bottom"] - box["top"]
    ends = [tuple(size * turn * (v[k] - box[side]) for v in (p, q)) for k, side, turn, size in (("x", "left", 1, height), ("x", "right", -1, height), ("y", "top", 1, width), ("y", "bottom", -1, width))]
    span = F.least(F.lit(1.0), *[_leaves(*e) for e in ends]) - F.greatest(F.lit(0.0), *[_enters(*e) for e in ends])
    held = lambda v: (v["x"] >= box["left"]) & (v["x"] <= box["right"]) & (v["y"] >= box["top"]) & (v["y"] <= box["bottom"])
    return F.when(held(p) & held(q), 1.0).otherwise(let(span, lambda d: F.when(d > TINY, d).otherwise(0.0)))


def coverage(points: Column, polygon: Column) -> Column:
    """Struct (share, method): share of a line's length inside; of its points if it has no length. points: structs (x, y), null where unknown."""
    return let(F.struct(line(points).alias("line"), shape(polygon).alias("shape")), lambda w: shape_coverage(w["line"], w["shape"]))


def line(points: Column) -> Column:
    """What coverage needs of a line: its points and their box, the pairs of known points that follow each other, with their distances, its
    length, and that of the pairs that have one."""
    n = F.size(points)
    pair = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("a"), b.alias("b"), F.hypot(b["x"] - a["x"], b["y"] - a["y"]).alias("length")))
    pairs = F.array_compact(F.zip_with(F.slice(points, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))), pair))
    total = lambda s, of: F.aggregate(s, F.lit(0.0), lambda acc, x: acc + of(x["length"]))
    some = lambda x: F.when(x > TINY, x).otherwise(0.0)
    return let(pairs, lambda s: F.struct(points.alias("points"), extent(points).alias("box"), s.alias("pairs"), total(s, lambda x: x).alias("length"), total(s, some).alias("measured")))


def point_inside(x: Column, y: Column, s: Column) -> Column:
    """Whether the point is in a polygon's shape; not true where it is unknown. All that a rectangle's box holds is inside."""
    rect = s["rect"]
    held = F.coalesce((x >= rect["left"]) & (x <= rect["right"]) & (y >= rect["top"]) & (y <= rect["bottom"]), F.lit(False))
    flat = F.coalesce(F.forall(s["planes"], lambda f: f["x"] * x + f["y"] * y + f["c"] > NEAR), F.lit(False))
    return held | flat | contains(x, y, s["sides"])


def shape_coverage(line: Column, s: Column) -> Column:
    """coverage of a line by a polygon's shape."""
    sides, box, flat, rect, own = s["sides"], s["box"], s["planes"], s["rect"], line["box"]

    def part(x: Column) -> Column:
        cut = F.when(flat.isNull(), inside_length(x["a"], x["b"], sides))
        cut = cut.when(x["length"] > TINY, F.when(rect.isNotNull(), rectangle_share(x["a"], x["b"], rect)).otherwise(convex_share(x["a"], x["b"], flat)) * x["length"])
        return F.when(apart(x["a"], x["b"], box), 0.0).otherwise(cut.otherwise(0.0))

    known = F.filter(line["points"], lambda p: p.isNotNull())
    share = F.size(F.filter(known, lambda p: point_inside(p["x"], p["y"], s))) / F.greatest(F.size(known), F.lit(1))
    # All of a line whose box a rectangle holds is inside.
    held = (own["left"] >= rect["left"]) & (own["right"] <= rect["right"]) & (own["top"] >= rect["top"]) & (own["bottom"] <= rect["bottom"])
    inside = F.when(held, line["measured"]).otherwise(F.aggregate(line["pairs"], F.lit(0.0), lambda acc, x: acc + part(x)))
    measured = F.struct(F.least(F.lit(1.0), F.greatest(F.lit(0.0), inside / line["length"])).alias("share"), F.lit("ARC_LENGTH").alias("method"))
    return F.when(line["length"] > TINY, measured).otherwise(F.struct(share.cast("double").alias("share"), F.lit("POINT_FALLBACK").alias("method")))


def overlap(a: Column, b: Column, flat_equal: float, tiny: float = TINY) -> Column:
    """Intersection over union of boxes (left, top, right, bottom). flat_equal: for equal boxes whose union is at most tiny; unequal
    ones give 0."""
    width = F.greatest(F.lit(0.0), F.least(a["right"], b["right"]) - F.greatest(a["left"], b["left"]))
    height = F.greatest(F.lit(0.0), F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"]))
    area = lambda r: (r["right"] - r["left"]) * (r["bottom"] - r["top"])
    both = width * height
    union = area(a) + area(b) - both
    return F.when(union <= tiny, F.when(a == b, flat_equal).otherwise(0.0)).otherwise(both / union)
