"""Polygons as ``array<struct<x: double, y: double>>``: column functions without UDFs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def polygon_of_rows(detections: DataFrame) -> DataFrame:
    """Example polygons: corners of the box around (cx, cy); cut to 2 or 3 vertices for some masks."""
    x0, x1 = F.col("cx") - F.col("w") / 2, F.col("cx") + F.col("w") / 2
    y0, y1 = F.col("cy") - F.col("h") / 2, F.col("cy") + F.col("h") / 2
    full = F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))
    n = F.when(F.col("mask_id") % 11 == 0, 2).when(F.col("mask_id") % 11 == 1, 3).otherwise(4)
    return detections.withColumn("polygon", F.slice(full, F.lit(1), n))


def area(p: Column | str) -> Column:
    """Absolute shoelace area."""
    p = _c(p)
    rotated = F.concat(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1))
    cross = F.zip_with(p, rotated, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2


def centroid(p: Column | str) -> Column:
    """Mean of the vertices."""
    p = _c(p)
    total = lambda k: F.aggregate(p, F.lit(0.0), lambda s, v: s + v[k])
    return F.when(F.size(p) > 0, F.struct((total("x") / F.size(p)).alias("x"), (total("y") / F.size(p)).alias("y")))


def bbox(p: Column | str, whole: bool = False) -> Column:
    """(x0, y0, x1, y1) of the vertices; truncated to integers with ``whole``."""
    p = _c(p)
    edge = lambda f, k: f(F.transform(p, lambda v: v[k]))
    values = {"x0": edge(F.array_min, "x"), "y0": edge(F.array_min, "y"), "x1": edge(F.array_max, "x"), "y1": edge(F.array_max, "y")}
    cut = lambda v: F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("long") if whole else v
    return F.struct(*[cut(v).alias(k) for k, v in values.items()])


def convex_hull(p: Column | str) -> Column:
    """The corners of the convex hull, in order around it; of one distinct vertex, none."""
    p = F.array_sort(F.array_distinct(F.filter(_c(p), lambda v: v["x"].isNotNull() & v["y"].isNotNull())))
    turn = lambda a, b, c: (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])
    # a chain that turns left only: the corners that a new vertex leaves are its first ones
    grown = lambda s, v: F.concat(F.filter(s, lambda b, i: (i == 0) | (turn(F.get(s, i - 1), b, v) > 0)), F.array(v))

    def side(points: Column) -> Column:
        return F.transform(F.array(F.aggregate(points, F.slice(points, 1, 0), grown)), lambda c: F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))))[0]

    return F.transform(F.array(p), lambda q: F.concat(side(q), side(F.reverse(q))))[0]


def minor_axis(p: Column | str) -> Column:
    """Short side of the least rectangle around the polygon.

    The least rectangle has a side along an edge of the convex hull, so the directions
    of the hull's edges are tried; ties go to the smaller short side.
    """
    best = F.array_min(_rectangles(p))
    return F.when(F.size(_c(p)) > 0, F.coalesce(best["short"], F.lit(0.0)))


def _rectangles(p: Column | str) -> Column:
    """(area, short side) of the enclosing rectangle along each edge of the convex hull."""
    extent = lambda v: F.array_max(v) - F.array_min(v)

    def along_edges(h: Column) -> Column:
        step = lambda a, b: F.struct((b["x"] - a["x"]).alias("x"), (b["y"] - a["y"]).alias("y"), F.hypot(b["x"] - a["x"], b["y"] - a["y"]).alias("n"))
        edges = F.transform(h, lambda a, i: step(a, F.get(h, (i + 1) % F.size(h))))

        def sides(d: Column) -> Column:
            along = F.transform(h, lambda v: (v["x"] * d["x"] + v["y"] * d["y"]) / d["n"])
            across = F.transform(h, lambda v: (v["y"] * d["x"] - v["x"] * d["y"]) / d["n"])
            return F.array(along, across)

        spans = F.transform(F.filter(edges, lambda d: d["n"] > 0), lambda d: F.transform(sides(d), extent))
        return F.transform(spans, lambda s: F.struct(F.round(s[0] * s[1], 6).alias("area"), F.least(s[0], s[1]).alias("short")))

    return F.transform(F.array(convex_hull(p)), along_edges)[0]


def valid(p: Column | str, least: int = 3) -> Column:
    """Whether the polygon has at least three vertices (false for null)."""
    return F.coalesce(F.size(_c(p)) >= least, F.lit(False)) & _c(p).isNotNull()


def resample(p: Column | str, k: int) -> Column:
    """At most k vertices: indices of k even steps from first to last, rounded half to even."""
    p = _c(p)
    step = (F.size(p) - 1).cast("double") / max(k - 1, 1)
    picked = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.get(p, F.rint(i * step).cast("int")))
    return F.when(F.size(p) > k, picked).otherwise(p)


def moved(p: Column | str, fx, fy) -> Column:  # noqa: ANN001
    """The polygon with each vertex mapped by fx(x, y), fy(x, y)."""
    return F.transform(_c(p), lambda v: F.struct(fx(v["x"], v["y"]).alias("x"), fy(v["x"], v["y"]).alias("y")))


def largest_contour(contours: Column | str, by: str = "vertices") -> Column:
    """Of several contours the one with most vertices (or largest area); the first on ties."""
    c = _c(contours)
    score = (lambda p: F.size(p).cast("double")) if by == "vertices" else area
    ranked = F.transform(c, lambda p, i: F.struct(score(p).alias("s"), (-i).alias("i"), p.alias("p")))
    return F.array_max(F.transform(ranked, lambda r: F.struct(r["s"].alias("s"), r["i"].alias("i"), r["p"].alias("p"))))["p"]


def contains(p: Column | str, x: Column, y: Column) -> Column:
    """Whether the point lies in the polygon or on its border: ray casting plus an on-edge test."""
    p = _c(p)
    rotated = F.concat(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1))
    edges = F.zip_with(p, rotated, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])

    def on_edge(e: Column) -> Column:
        a, b = e["a"], e["b"]
        flat = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"]) == 0
        return flat & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    count = F.size(F.filter(edges, lambda e: F.coalesce(crosses(e), F.lit(False))))
    return (count % 2 == 1) | F.exists(edges, on_edge)


def minor_area(p: Column | str) -> Column:
    """Area of the least rectangle around the polygon (see ``minor_axis``)."""
    return F.coalesce(F.array_min(_rectangles(p))["area"], F.lit(0.0))
