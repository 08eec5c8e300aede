"""Coordinate frames: overview pixels, full-size pixels, stage microns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import polygons as poly


def geometry_of(images: DataFrame) -> DataFrame:
    """The geometry row of each image: both axes' scale, the stage anchor and the fixed axis rule (swapped, both signs +1)."""
    anchored = F.col("size_s") == 1
    return images.select(
        "image_id", "zoom", "origin_x", "origin_y", F.col("scale_m").alias("scale_x"), F.col("scale_m").alias("scale_y"),
        F.when(anchored, F.col("image_id") * 1000.0).alias("stage_cx"), F.when(anchored, F.col("image_id") * 500.0).alias("stage_cy"),
        (F.col("size_x") / 2).alias("center_x"), (F.col("size_y") / 2).alias("center_y"), F.lit(1).alias("x_dir"), F.lit(1).alias("y_dir"), F.lit(True).alias("swap_xy"),
    )


def to_fullres(shapes: DataFrame, geometry: DataFrame, column: str = "polygon") -> DataFrame:
    """Overview pixels to full-size pixels; unchanged where the image has no geometry."""
    return _mapped(shapes, geometry, column, lambda x, y: F.col("__g.origin_x") + x / F.col("__g.zoom"), lambda x, y: F.col("__g.origin_y") + y / F.col("__g.zoom"), True)


def to_overview(shapes: DataFrame, geometry: DataFrame, column: str = "polygon") -> DataFrame:
    """Full-size pixels to overview pixels; unchanged where the image has no geometry."""
    return _mapped(shapes, geometry, column, lambda x, y: (x - F.col("__g.origin_x")) * F.col("__g.zoom"), lambda x, y: (y - F.col("__g.origin_y")) * F.col("__g.zoom"), True)


def to_stage_um(shapes: DataFrame, geometry: DataFrame, column: str = "polygon") -> DataFrame:
    """Full-size pixels to stage microns; null where scale or anchor is missing."""
    g = lambda c: F.col(f"__g.{c}")
    fx, fy = lambda x, y: (x - g("center_x")) * g("scale_x") * 1e6 * g("x_dir"), lambda x, y: (y - g("center_y")) * g("scale_y") * 1e6 * g("y_dir")
    return _mapped(shapes, geometry, column, lambda x, y: g("stage_cx") + F.when(g("swap_xy"), fy(x, y)).otherwise(fx(x, y)), lambda x, y: g("stage_cy") + F.when(g("swap_xy"), fx(x, y)).otherwise(fy(x, y)), False)


def from_stage_um(shapes: DataFrame, geometry: DataFrame, column: str = "polygon") -> DataFrame:
    """Stage microns to full-size pixels; null where scale or anchor is missing."""
    g = lambda c: F.col(f"__g.{c}")
    dx, dy = lambda x, y: x - g("stage_cx"), lambda x, y: y - g("stage_cy")
    px = lambda x, y: g("center_x") + F.when(g("swap_xy"), dy(x, y)).otherwise(dx(x, y)) / (g("scale_x") * 1e6) * g("x_dir")
    py = lambda x, y: g("center_y") + F.when(g("swap_xy"), dx(x, y)).otherwise(dy(x, y)) / (g("scale_y") * 1e6) * g("y_dir")
    return _mapped(shapes, geometry, column, px, py, False)


def _mapped(shapes: DataFrame, geometry: DataFrame, column: str, fx, fy, keep: bool) -> DataFrame:  # noqa: ANN001
    rows = shapes.join(geometry.select("image_id", F.struct(*[c for c in geometry.columns if c != "image_id"]).alias("__g")), "image_id", "left")
    need = ("zoom",) if keep else ("scale_x", "scale_y", "stage_cx", "stage_cy", "center_x", "center_y")
    have: Column = F.lit(True)
    for c in need:
        have = have & F.col(f"__g.{c}").isNotNull()
    other = F.col(column) if keep else F.lit(None)
    return rows.withColumn(column, F.when(have, poly.moved(column, fx, fy)).otherwise(other)).drop("__g")


def frame_migrate(shapes: DataFrame, bands: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Polygons times r and per-image thresholds times r or r squared, r = new zoom / old zoom; nothing
    changes where the zooms agree to 1e-9.  bands(image_id, min_area, max_area, section_px)."""
    r = old.select("image_id", F.col("zoom").alias("z0")).join(new.select("image_id", F.col("zoom").alias("z1")), "image_id")
    ratio = F.when(F.abs(F.col("z1") - F.col("z0")) <= 1e-9 * F.greatest(F.lit(1.0), F.col("z0")), 1.0).otherwise(F.col("z1") / F.col("z0"))
    rows = shapes.join(r.select("image_id", ratio.alias("r")), "image_id").join(bands, "image_id", "left")
    rows = rows.withColumn("polygon", poly.moved("polygon", lambda x, y: x * F.col("r"), lambda x, y: y * F.col("r")))
    return rows.withColumns({"min_area": F.col("min_area") * F.col("r") * F.col("r"), "max_area": F.col("max_area") * F.col("r") * F.col("r"), "section_px": F.col("section_px") * F.col("r")})
