"""Calibration of detection parameters from example polygons, many images at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import polygons as poly
from ..functions.lineage import cut
from .ranks import at_share, running

#: Fixed values of the calibration rule.
RESOLVE_PX, SAM_PX, TARGET_POINTS = 24.0, 1024.0, 2.0


def _clip(v: Column, lo: Column | float, hi: Column | float) -> Column:
    as_col = lambda x: F.lit(x) if isinstance(x, (int, float)) else x
    return F.least(F.greatest(v, as_col(lo)), as_col(hi))


def calibrate(examples: DataFrame, settings: DataFrame) -> DataFrame:
    """One wide row per image of settings(image_id, zoom, ov_given, tile_cap, batch, model).

    examples(image_id, polygon): polygons with an area over 0 count.  zoom null or 0 is 1;
    ov_given null: the overview is chosen; caps and host columns may be null.  An image
    without usable examples has n_examples 0, error true and nulls.
    """
    return _calibrated(_sized(examples), settings)


def _sized(examples: DataFrame) -> DataFrame:
    """(image_id, a, m): area and minor axis of the examples that count."""
    return examples.select("image_id", poly.area("polygon").alias("a"), poly.minor_axis("polygon").alias("m")).where("a > 0")


def _calibrated(sized: DataFrame, settings: DataFrame) -> DataFrame:
    stats = sized.groupBy("image_id").agg(F.count("*").alias("n_examples"), F.percentile("a", 0.5).alias("median_area"), F.percentile("m", 0.5).alias("minor_px"))
    c = F.col
    df = settings.join(stats, "image_id", "left").withColumn("n_examples", F.coalesce("n_examples", F.lit(0)).cast("long")).withColumn("error", c("n_examples") == 0)
    df = df.withColumn("z", F.when(F.coalesce("zoom", F.lit(0.0)) == 0, 1.0).otherwise(c("zoom"))).withColumn("section_px", F.sqrt("median_area"))
    df = df.withColumn("ov_long", F.coalesce(c("ov_given").cast("double"), F.greatest(F.rint(40 * c("section_px")), F.lit(2048.0))))
    df = df.withColumn("cap", F.coalesce(c("tile_cap").cast("double"), F.lit(4096.0)))
    df = df.withColumn("apparent", c("minor_px") * SAM_PX / F.greatest("ov_long", F.lit(1.0)))
    need = _clip(F.rint(c("minor_px") * SAM_PX / RESOLVE_PX), 256.0, c("ov_long"))
    tile = F.when(c("minor_px") >= RESOLVE_PX, F.when(c("ov_long") > SAM_PX, SAM_PX).otherwise(c("ov_long"))).otherwise(F.floor(need).cast("double"))
    df = df.withColumn("tile_px", F.least(tile, "cap")).withColumn("tiled", c("tile_px") < c("ov_long"))
    df = df.withColumn("pps", _clip(F.ceil(c("tile_px") * F.sqrt(TARGET_POINTS / F.greatest("median_area", F.lit(1.0)))).cast("double"), 16.0, 128.0))
    df = df.withColumn("points", c("median_area") * F.pow(c("pps") / F.greatest("tile_px", F.lit(1.0)), F.lit(2)))
    df = df.withColumn("d", c("section_px") * SAM_PX / F.greatest("tile_px", F.lit(1.0)))
    share = 1.5 * c("section_px") / F.greatest("tile_px", F.lit(1.0))
    deep = c("d") >= 16
    # the overview that would make the thin axis large enough, only where a size was given
    full = c("ov_given") / c("z")
    n_need = F.greatest(F.lit(1.0), F.ceil(RESOLVE_PX / F.greatest("apparent", F.lit(1e-6))).cast("double"))
    by_full = F.greatest(F.lit(1.0), F.floor(full / SAM_PX).cast("double"))
    by_cap = F.when(c("tile_cap").isNotNull(), F.greatest(F.lit(1.0), F.floor(c("tile_cap") / SAM_PX).cast("double"))).otherwise(n_need)
    n = _clip(n_need, 1.0, F.least(by_full, by_cap))
    given = c("ov_given").isNotNull() & ~c("error")
    known = lambda v: F.when(~c("error"), v)  # noqa: E731  greatest and least skip nulls
    return df.select(
        "image_id", "n_examples", "error", "median_area", "minor_px", "section_px",
        (c("section_px") / c("z")).alias("section_px_full"), (c("minor_px") / c("z")).alias("minor_px_full"), (c("median_area") / (c("z") * c("z"))).alias("median_area_full"),
        "ov_long", known(c("tile_px")).alias("tile_px"), known(c("tiled")).alias("tiled"), known(c("pps")).alias("pps"), "points", known(_clip(share, 0.15, 0.5)).alias("tile_overlap"), known(_clip(share, 0.2, 0.6)).alias("crop_overlap"),
        F.when(~c("error"), F.when(deep, 0).otherwise(1)).cast("long").alias("crop_layers"), F.when(~c("error"), F.when(deep, 1).otherwise(2)).cast("long").alias("crop_downscale"),
        F.when(c("d") >= 20, 0.85).when(c("d") >= 10, 0.80).when(~c("error"), 0.75).alias("iou_threshold"), F.when(c("d") >= 20, 0.96).when(c("d") >= 10, 0.95).when(~c("error"), 0.92).alias("stability_threshold"),
        (0.5 * c("median_area")).alias("min_area"), (2.0 * c("median_area")).alias("max_area"), F.rint(0.05 * c("median_area")).alias("cleanup_floor"),
        F.coalesce("batch", F.lit(16)).cast("long").alias("batch"), F.coalesce("model", F.lit("base_plus")).alias("model"),
        F.when(given, c("apparent")).alias("whole_image_section_px"), F.when(given, SAM_PX * n).alias("recommended_overview"),
    )


def calibrate_two_pass(examples: DataFrame, settings: DataFrame) -> DataFrame:
    """Where a slide's recommended overview differs from the given one: examples scaled to it, then calibrated again.

    settings as for ``calibrate`` with is_slide.  Adds pass (1 or 2).
    """
    sized = cut(_sized(examples))  # both passes need it
    once = cut(_calibrated(sized, settings))
    ask = settings.join(once.select("image_id", "recommended_overview"), "image_id")
    again = F.col("is_slide") & F.col("recommended_overview").isNotNull() & (F.col("recommended_overview") != F.col("ov_given"))
    redo = ask.where(again).withColumn("r", F.col("recommended_overview") / F.col("ov_given"))
    # sizes are scaled, not corners: areas of moved corners differ in the last digit, which decides at the rule's thresholds
    scaled = sized.join(redo.select("image_id", "r"), "image_id").select("image_id", (F.col("a") * F.col("r") * F.col("r")).alias("a"), (F.col("m") * F.col("r")).alias("m"))
    second = redo.withColumn("zoom", F.when(F.coalesce("zoom", F.lit(0.0)) == 0, 1.0).otherwise(F.col("zoom")) * F.col("r")).withColumn("ov_given", F.col("recommended_overview"))
    twice = _calibrated(scaled, second.select(*settings.columns))
    first = once.join(redo.select("image_id"), "image_id", "left_anti")
    return first.withColumn("pass", F.lit(1)).union(twice.withColumn("pass", F.lit(2)))


def calibration_summary(calibrated: DataFrame) -> DataFrame:
    """A plain line per image."""
    line = F.format_string(
        "calibrated from %d examples: section ~%dpx (thin ~%dpx, area %d); %s tile_px=%d, points_per_side=%d, pred_iou=%.2f",
        "n_examples", F.rint("section_px").cast("long"), F.rint("minor_px").cast("long"), F.rint("median_area").cast("long"), F.when(F.col("tiled"), "tiles").otherwise("single tile"), F.col("tile_px").cast("long"), F.col("pps").cast("long"), "iou_threshold",
    )
    return calibrated.select("image_id", F.when(F.col("error"), "no usable example").otherwise(line).alias("summary"))


def contrast_cuts(pixels: DataFrame, low: float = 0.01, high: float = 0.995) -> DataFrame:
    """Cuts (lo, hi) per image at two exact percentiles.  If hi reaches the maximum, it is taken among
    the smaller values, if there are any; if hi does not exceed lo, it is lo + 1."""
    counts = pixels.where(F.col("v").isNotNull()).groupBy("image_id", "v").agg(F.count("*").alias("n"))
    ranked, under = running(counts, ["v"], "n"), F.col("total") - F.col("n_top")
    tops = ranked.where(F.col("before") + F.col("n") == F.col("total")).select("image_id", F.col("v").alias("top"), F.col("n").alias("n_top"))
    cut_at = lambda share, total: at_share(share, "v", "before", "n", total)
    rows = ranked.join(tops, "image_id").groupBy("image_id").agg(F.max("top").alias("top"), cut_at(low, F.col("total")).alias("lo"), cut_at(high, F.col("total")).alias("hi"), cut_at(high, under).alias("hi2"))
    rows = rows.withColumn("hi", F.when((F.col("hi") >= F.col("top")) & F.col("hi2").isNotNull(), F.col("hi2")).otherwise(F.col("hi")))
    return rows.select("image_id", "lo", F.when(F.col("hi") <= F.col("lo"), F.col("lo") + 1).otherwise(F.col("hi")).alias("hi"))


def contrast_apply(pixels: DataFrame, cuts: DataFrame, gamma: float | None = None) -> DataFrame:
    """Pixel values stretched to 0..255 between the image's cuts; gamma is skipped if null or 0."""
    unit = _clip((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")), 0.0, 1.0)
    unit = F.pow(unit, F.lit(gamma)) if gamma else unit
    return pixels.join(cuts, "image_id").withColumn("byte", F.floor(unit * 255).cast("long")).drop("lo", "hi")
