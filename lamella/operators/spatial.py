"""Binned spatial joins and the fixed-point resolver of order-dependent rules.

A condition like abs(dx) < r would be a nested loop per image.  Points are binned into
square cells instead, so every join here is an equi-join on (image_id, cell).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import polygons as poly
from ..functions.lineage import cut


def resolve(items: DataFrame, edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """The ids that a sequential pass would keep.

    items(id); edges(later, earlier): ``later`` is dropped if ``earlier`` is kept.  An id is
    kept as soon as all its earlier neighbours are dropped and dropped as soon as one is
    kept; a round decides all ids that can be, and rounds are as many as the longest chain of decisions.
    """
    left = cut(edges.select("later", "earlier").distinct())
    waiting = lambda e: e.select(F.col("later").alias("id")).distinct()
    fresh = cut(items.select("id").join(waiting(left), "id", "left_anti"))
    kept = fresh
    for n in range(most_rounds):
        if not left.take(1):
            return kept
        dropped = cut(left.join(fresh.withColumnRenamed("id", "earlier"), "earlier", "left_semi").select(F.col("later").alias("id")).distinct())
        shorter = cut(left.join(dropped.withColumnRenamed("id", "later"), "later", "left_anti").join(dropped.withColumnRenamed("id", "earlier"), "earlier", "left_anti"))
        # who waited, was not dropped and waits for nobody now is kept
        fresh = cut(waiting(left).join(dropped, "id", "left_anti").join(waiting(shorter), "id", "left_anti"))
        kept, left = kept.union(fresh), shorter
        if (n + 1) % 20 == 0:
            kept = cut(kept)  # so that the plan does not grow with the rounds
    raise RuntimeError(f"undecided after {most_rounds} rounds")


def _cell(v: Column, size: Column | float) -> Column:
    return F.floor(v / size)


def conflict_edges(points: DataFrame) -> DataFrame:
    """(later, earlier) for points(id, image_id, rank, x, y, r): abs(dx) < r and abs(dy) < r with the later one's r.
    ``rank`` is a number or a struct that tells the order; it is compared inside cells only, so no image is sorted.

    Cells are powers of four at least 2 * r wide, so that classes are few; earlier points stand once in the grid of each
    class that their image has, later ones probe the cells of their own class that their reach touches, at most two by two.
    """
    sized = points.withColumn("cls", 2 * F.ceil((F.log2(F.greatest("r", F.lit(1e-9))) + 1) / 2).cast("int"))
    size = F.pow(F.lit(2.0), F.col("cls"))
    classes = sized.select("image_id", "cls").distinct()
    grid = points.select("image_id", F.col("id").alias("earlier"), F.col("rank").alias("er"), F.col("x").alias("ex"), F.col("y").alias("ey")).join(classes, "image_id")
    grid = grid.withColumn("cx", _cell(F.col("ex"), size)).withColumn("cy", _cell(F.col("ey"), size))
    touched = lambda c: F.explode(F.sequence(_cell(F.col(c) - F.col("r"), size), _cell(F.col(c) + F.col("r"), size)))
    probe = sized.withColumn("cx", touched("x")).withColumn("cy", touched("y"))
    met = probe.join(grid, ["image_id", "cls", "cx", "cy"]).where((F.col("er") < F.col("rank")) & (F.abs(F.col("x") - F.col("ex")) < F.col("r")) & (F.abs(F.col("y") - F.col("ey")) < F.col("r")))
    return met.select(F.col("id").alias("later"), "earlier")


def cross_tile_dedup(sections: DataFrame) -> DataFrame:
    """Greedy de-duplication in the order (tile_idx, area descending, mask_id): a section goes if a kept
    earlier one lies within half the root of its own area on both axes.  sections(image_id, mask_id, tile_idx, area, cx, cy)."""
    rank = F.struct("tile_idx", (-F.col("area")).alias("a"), "mask_id")
    points = cut(sections.select(F.col("mask_id").alias("id"), "image_id", rank.alias("rank"), F.col("cx").alias("x"), F.col("cy").alias("y"), (0.5 * F.sqrt(F.greatest("area", F.lit(1.0)))).alias("r")))
    kept = resolve(points, conflict_edges(points))
    return sections.join(kept.withColumnRenamed("id", "mask_id"), "mask_id", "left_semi")


def overlap_edges(boxes: DataFrame, threshold: float, cell: float = 64.0) -> DataFrame:
    """(later, earlier) for boxes(id, image_id, rank, x0, y0, x1, y1) with intersection over union above the threshold; rank as in ``conflict_edges``."""
    cells = lambda a, z: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(z) / cell)))
    spread = boxes.withColumn("gx", cells("x0", "x1")).withColumn("gy", cells("y0", "y1"))
    other = spread.select("image_id", "gx", "gy", F.col("id").alias("earlier"), F.col("rank").alias("er"), *[F.col(c).alias(f"e{c}") for c in ("x0", "y0", "x1", "y1")])
    ax, ay = F.greatest("x0", "ex0"), F.greatest("y0", "ey0")
    w, h = F.least("x1", "ex1") - ax, F.least("y1", "ey1") - ay
    inter = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    union = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) + (F.col("ex1") - F.col("ex0")) * (F.col("ey1") - F.col("ey0")) - inter
    once = (F.floor(ax / cell) == F.col("gx")) & (F.floor(ay / cell) == F.col("gy"))  # each pair in one cell only
    met = spread.join(other, ["image_id", "gx", "gy"]).where((F.col("er") < F.col("rank")) & once & (inter > threshold * union))
    return met.select(F.col("id").alias("later"), "earlier")


def box_nms(masks: DataFrame, threshold: float = 0.7, order: str = "pred_iou") -> DataFrame:
    """Non-maximum suppression of boxes (cx, cy, w, h) by descending ``order``, then mask_id."""
    rank = F.struct((-F.col(order)).alias("o"), "mask_id")
    x0, y0 = F.col("cx") - F.col("w") / 2, F.col("cy") - F.col("h") / 2
    boxes = cut(masks.select(F.col("mask_id").alias("id"), "image_id", rank.alias("rank"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("w")).alias("x1"), (y0 + F.col("h")).alias("y1")))
    kept = resolve(boxes, overlap_edges(boxes, threshold))
    return masks.join(kept.withColumnRenamed("id", "mask_id"), "mask_id", "left_semi")


def marker_import(markers: DataFrame, fiducials: DataFrame, radius: float = 4.0) -> DataFrame:
    """Markers (image_id, marker_id, x, y) that join the fiducials (image_id, x, y): not within ``radius`` of an
    existing one nor of a marker added before, in the order of marker_id.  A second import adds nothing."""
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    near = lambda df: df.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps)).withColumn("gx", F.floor(F.col("x") / radius) + F.col("dx")).withColumn("gy", F.floor(F.col("y") / radius) + F.col("dy")).drop("dx", "dy")
    at = lambda df, p: df.select("image_id", F.floor(F.col("x") / radius).alias("gx"), F.floor(F.col("y") / radius).alias("gy"), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"), *([F.col("marker_id").alias("earlier")] if "marker_id" in df.columns else []))
    close = lambda p: F.hypot(F.col("x") - F.col(f"{p}x"), F.col("y") - F.col(f"{p}y")) < radius
    usable = markers.where("x is not null and y is not null")
    known = near(usable).join(at(fiducials, "f"), ["image_id", "gx", "gy"]).where(close("f")).select("marker_id").distinct()
    fresh = cut(usable.join(known, "marker_id", "left_anti"))
    edges = near(fresh).join(at(fresh, "m"), ["image_id", "gx", "gy"]).where(close("m") & (F.col("earlier") < F.col("marker_id"))).select(F.col("marker_id").alias("later"), "earlier")
    kept = resolve(fresh.select(F.col("marker_id").alias("id")), edges)
    return fresh.join(kept.withColumnRenamed("id", "marker_id"), "marker_id", "left_semi")


def points_in_polygons(points: DataFrame, sections: DataFrame, cell: float = 64.0) -> DataFrame:
    """points(image_id, point_id, x, y) joined to the sections(image_id, mask_id, area, polygon) that contain them (border included)."""
    box = poly.bbox("polygon")
    cells = lambda a, z: F.explode(F.sequence(F.floor(F.col("box")[a] / cell), F.floor(F.col("box")[z] / cell)))
    spread = sections.where(poly.valid("polygon")).withColumn("box", box).withColumn("gx", cells("x0", "x1")).withColumn("gy", cells("y0", "y1"))
    placed = points.withColumn("gx", F.floor(F.col("x") / cell)).withColumn("gy", F.floor(F.col("y") / cell))
    inside = F.col("x").between(F.col("box.x0"), F.col("box.x1")) & F.col("y").between(F.col("box.y0"), F.col("box.y1"))
    return placed.join(spread, ["image_id", "gx", "gy"]).where(inside & poly.contains("polygon", F.col("x"), F.col("y"))).select("image_id", "point_id", "mask_id", "area")


def click_to_section(clicks: DataFrame, sections: DataFrame) -> DataFrame:
    """The smallest section that contains each click(image_id, click_id, x, y); null if none does."""
    points = clicks.withColumnRenamed("click_id", "point_id")
    hits = points_in_polygons(points, sections).groupBy("image_id", "point_id").agg(F.min_by("mask_id", F.struct("area", "mask_id")).alias("mask_id"))
    return points.join(hits, ["image_id", "point_id"], "left").select("image_id", F.col("point_id").alias("click_id"), "mask_id")


def seed_coverage(points: DataFrame, sections: DataFrame, tile_px: float, pps: int) -> DataFrame:
    """Prompt points in each valid section, beside the expected number area * (pps / tile)**2; sections without points show 0."""
    hits = points_in_polygons(points, sections).groupBy("image_id", "mask_id").agg(F.count("*").alias("n"))
    rows = sections.where(poly.valid("polygon")).join(hits, ["image_id", "mask_id"], "left")
    expected = poly.area("polygon") * (pps / tile_px) ** 2
    return rows.select("image_id", "mask_id", F.coalesce("n", F.lit(0)).alias("n_points"), expected.alias("expected"), (F.coalesce("n", F.lit(0)) >= 2).alias("reached"))


#: Fiducials of an image that meet all others in one task.
FIDUCIALS = 256


def fiducial_distances(fiducials: DataFrame) -> DataFrame:
    """Distances of all i < j fiducials of an image, named fiducial_i-fiducial_j.

    An image's fiducials are dealt into parts, and each part meets all of them, so that a large image is many tasks.
    """
    n = fiducials.groupBy("image_id").agg(F.ceil(F.count("*") / FIDUCIALS).cast("int").alias("parts"))
    a = fiducials.join(n, "image_id").select("image_id", F.pmod(F.xxhash64("idx"), F.col("parts")).cast("int").alias("part"), F.col("idx").alias("i"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = fiducials.join(n, "image_id").select("image_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("idx").alias("j"), F.col("x").alias("bx"), F.col("y").alias("by"))
    # a given number of tasks on both sides: what is joined is small, its pairs are not
    tasks = int(fiducials.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal = lambda df: df.repartition(tasks, "image_id", "part")
    pairs = deal(a).join(deal(b).hint("merge"), ["image_id", "part"]).where("i < j")
    return pairs.select("image_id", F.concat(F.lit("fiducial_"), "i", F.lit("-fiducial_"), "j").alias("name"), F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")).alias("distance"))
