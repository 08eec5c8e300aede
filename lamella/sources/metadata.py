"""Slide metadata XML: sizes, scales, anchors and stage markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .annotations import well_formed


def _tag(name: str) -> Column:
    """Text of the first element of this name; null if absent."""
    return F.nullif(F.trim(F.regexp_extract("xml", rf"(?s)<{name}[^>]*>(.*?)</{name}>", 1)), F.lit(""))


def _whole(v: Column) -> Column:
    return F.when(v.rlike(r"^[+-]?\d+$"), v.try_cast("long"))


def image_metadata_read(documents: DataFrame) -> DataFrame:
    """One row per document(image_id, xml): sizes, scales in metres, pixel type and the scene centre in microns.

    The centre comes from the scene, else from a tile region; documents of several scenes and malformed ones have none.
    """
    scale = lambda axis: F.regexp_extract(F.regexp_extract("xml", rf'(?s)<Distance Id="{axis}">(.*?)</Distance>', 1), r"<Value>(.*?)</Value>", 1).try_cast("double")
    ok = well_formed("xml")
    centre = lambda scope: F.regexp_extract(F.regexp_extract("xml", rf"(?s)<{scope}\b(.*?)</{scope}>", 1), r"(?s)<CenterPosition>(.*?)</CenterPosition>", 1)
    text = F.coalesce(F.nullif(centre("Scenes"), F.lit("")), F.nullif(centre("TileRegions"), F.lit("")))
    part = lambda k: F.get(F.split(text, ","), F.lit(k)).try_cast("double")
    single = F.coalesce(F.col("size_s") == 1, F.lit(True))
    rows = documents.withColumns({"size_s": _whole(_tag("SizeS")), "__ok": ok})
    anchored = F.col("__ok") & single & part(0).isNotNull() & part(1).isNotNull()
    return rows.select(
        "image_id", _whole(_tag("SizeX")).alias("size_x"), _whole(_tag("SizeY")).alias("size_y"), _whole(_tag("SizeC")).alias("size_c"), "size_s", _whole(_tag("SizeM")).alias("size_m"),
        scale("X").alias("scale_x"), scale("Y").alias("scale_y"), _tag("PixelType").alias("pixel_type"), F.when(anchored, part(0)).alias("center_x_um"), F.when(anchored, part(1)).alias("center_y_um"),
    )


def stage_markers_read(documents: DataFrame) -> DataFrame:
    """(image_id, idx, marker, stage_x_um, stage_y_um, focus_um, holder, microscope) of the first calibration.

    Markers without a usable X or Y are left out; a bad focus is null; malformed documents give no row.
    """
    block = F.regexp_extract("xml", r"(?s)<ShuttleAndFindData\b.*?<Calibration\b(.*?)</Calibration>", 1)
    inner = lambda name: F.nullif(F.regexp_extract("b", rf"(?s)<{name}>(.*?)</{name}>", 1), F.lit(""))
    attr = lambda name: F.regexp_extract("m", rf'\b{name}="([^"]*)"', 1)
    ok = documents.where(well_formed("xml")).select("image_id", block.alias("b"))
    tags = ok.select("image_id", inner("Holder").alias("holder"), inner("MicroscopeType").alias("microscope"), F.posexplode(F.regexp_extract_all("b", F.lit(r"<Marker\s[^>]*>"), 0)).alias("idx", "m"))
    rows = tags.select("image_id", F.col("idx").cast("long").alias("idx"), F.nullif(attr("Id"), F.lit("")).alias("marker"), attr("StageXPosition").try_cast("double").alias("stage_x_um"), attr("StageYPosition").try_cast("double").alias("stage_y_um"), attr("FocusPosition").try_cast("double").alias("focus_um"), "holder", "microscope")
    return rows.where("stage_x_um is not null and stage_y_um is not null")


def marker_merge(existing: DataFrame, new: DataFrame, replace: bool = True) -> DataFrame:
    """Markers(image_id, marker, x, y, focus) after a write: new ones are numbered past the largest trailing
    integer that stays, a missing focus takes the mean of the previous ones; numbers are text with 6 decimals."""
    from pyspark.sql import Window

    number = F.regexp_extract("marker", r"(\d+)\s*$", 1).try_cast("long")
    before = existing.groupBy("image_id").agg(F.avg("focus").alias("mean_focus"), F.max(number).alias("top"))
    rows = new.join(before, "image_id", "left").withColumn("n", F.row_number().over(Window.partitionBy("image_id").orderBy("idx")))
    start = F.lit(0) if replace else F.coalesce("top", F.lit(0))
    six = lambda v: F.format_string("%.6f", v)
    focus = F.coalesce("focus", "mean_focus")
    added = rows.select("image_id", F.concat(F.lit("Marker:"), F.col("n") + start).alias("marker"), six(F.col("x")).alias("x"), six(F.col("y")).alias("y"), F.when(focus.isNotNull(), six(focus)).alias("focus"))
    kept = existing.join(new.select("image_id").distinct(), "image_id", "left_anti") if replace else existing
    return kept.select("image_id", "marker", six(F.col("x")).alias("x"), six(F.col("y")).alias("y"), F.when(F.col("focus").isNotNull(), six(F.col("focus"))).alias("focus")).union(added)
