"""Gates on single detections and per-image bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import polygons as poly
from .ranks import percentiles, running


def quality_gate(masks: DataFrame, iou: float = 0.7, stability: float = 0.92) -> DataFrame:
    """Keeps pred_iou > iou and stability >= stability."""
    return masks.where((F.col("pred_iou") > iou) & (F.col("stability") >= stability))


def stability_score(logits: DataFrame, threshold: float = 0.0, offset: float = 1.0) -> DataFrame:
    """count(logit > T + offset) / count(logit > T - offset) per (image_id, mask_id); null if none is over the lower cut."""
    hit = lambda t: F.sum((F.col("logit") > t).cast("long"))
    return logits.groupBy("image_id", "mask_id").agg((hit(threshold + offset) / F.nullif(hit(threshold - offset), F.lit(0))).alias("stability"))


def tile_edge_reject(masks: DataFrame, tiles: DataFrame, images: DataFrame, margin: int = 2) -> DataFrame:
    """Drops masks (tile-local bx, by, bw, bh) that touch a tile edge which is not an image border."""
    frame = tiles.join(images.select("image_id", "size_x", "size_y"), "image_id")
    rows = masks.join(frame, ["image_id", "tile_idx"])
    left = (F.col("bx") <= margin) & (F.col("x0") > 0)
    top = (F.col("by") <= margin) & (F.col("y0") > 0)
    right = (F.col("bx") + F.col("bw") >= F.col("w") - margin) & (F.col("x0") + F.col("w") < F.col("size_x"))
    bottom = (F.col("by") + F.col("bh") >= F.col("h") - margin) & (F.col("y0") + F.col("h") < F.col("size_y"))
    return rows.where(~(left | top | right | bottom)).select(*masks.columns)


def size_band(masks: DataFrame, bands: DataFrame) -> DataFrame:
    """Keeps min_area <= area <= max_area of the image's band; 0 and infinity where it has none."""
    lo, hi = F.coalesce("min_area", F.lit(0.0)), F.coalesce("max_area", F.lit(float("inf")))
    return masks.join(bands.select("image_id", "min_area", "max_area"), "image_id", "left").where(F.col("area").between(lo, hi)).drop("min_area", "max_area")


def median_band(masks: DataFrame, low: float = 0.2, high: float = 5.0) -> DataFrame:
    """Keeps areas in [low, high] x the image's median area."""
    middle = percentiles(masks, "area", {"median_area": 0.5})
    return masks.join(middle, "image_id").where(F.col("area").between(low * F.col("median_area"), high * F.col("median_area"))).drop("median_area")


def shape_gate(sections: DataFrame, images: DataFrame, most_ratio: float = 8.0, least_fill: float = 0.4, most_cover: float = 0.5) -> DataFrame:
    """Drops polygons that are too elongated, too concave or cover most of the image."""
    rows = sections.where(poly.valid("polygon")).withColumn("__a", poly.area("polygon")).withColumn("__s", poly.minor_axis("polygon")).withColumn("__r", poly.minor_area("polygon"))
    rows = rows.join(images.select("image_id", "size_x", "size_y"), "image_id")
    long_side = F.col("__r") / F.nullif(F.col("__s"), F.lit(0.0))
    ok = (long_side / F.nullif(F.col("__s"), F.lit(0.0)) <= most_ratio) & (F.col("__a") / F.nullif(F.col("__r"), F.lit(0.0)) >= least_fill) & (F.col("__a") <= most_cover * F.col("size_x") * F.col("size_y"))
    return rows.where(ok).select(*sections.columns)


def best_mask_per_prompt(candidates: DataFrame) -> DataFrame:
    """Of each prompt's candidates the one with the best pred_iou; the least mask_id on ties."""
    return candidates.groupBy("image_id", "prompt_id").agg(F.max_by(F.struct("mask_id", "pred_iou"), F.struct("pred_iou", -F.col("mask_id"))).alias("m")).select("image_id", "prompt_id", "m.mask_id", "m.pred_iou")


def filter_funnel(masks: DataFrame, bands: DataFrame, kept: DataFrame) -> DataFrame:
    """Per image: raw masks, masks in the band, masks kept; one aggregate over one join."""
    lo, hi = F.coalesce("min_area", F.lit(0.0)), F.coalesce("max_area", F.lit(float("inf")))
    rows = masks.join(bands.select("image_id", "min_area", "max_area"), "image_id", "left").join(kept.select("image_id", "mask_id", F.lit(1).alias("__kept")), ["image_id", "mask_id"], "left")
    return rows.groupBy("image_id").agg(F.count("*").alias("n_raw"), F.count_if(F.col("area").between(lo, hi)).alias("n_band"), F.count("__kept").alias("n_kept"))


def masks_by_area(masks: DataFrame) -> DataFrame:
    """Adds the position (0, 1, ..) of each mask by descending area."""
    return running(masks, [F.desc("area"), F.col("mask_id")]).withColumnRenamed("before", "position").drop("total")


def section_ids(masks: DataFrame, order: str = "mask_id") -> DataFrame:
    """Adds section_1 .. section_n in the given order."""
    return masks.withColumn("section_id", F.concat(F.lit("section_"), F.row_number().over(Window.partitionBy("image_id").orderBy(order))))


def run_summary(masks: DataFrame) -> DataFrame:
    """Masks and confirmed sections per (image, tile) with running totals, and a total row per image (tile_idx null)."""
    rolled = masks.rollup("image_id", "tile_idx").agg(F.count("*").alias("n_masks"), F.count_if("confirmed").alias("n_sections"), F.grouping_id().alias("g")).where("g < 3")
    running = F.sum(F.when(F.col("g") == 0, F.col("n_sections"))).over(Window.partitionBy("image_id").orderBy(F.asc_nulls_last("tile_idx")))
    return rolled.withColumn("running", running).drop("g")
