"""Row generators: tile plans, prompt grids, crop boxes, pyramids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.polygons import point


def _span(i: Column, n: Column, length: Column, overlap: float) -> tuple[Column, Column]:
    """Start and size of the i-th of n spans, both rounded half to even after subtracting."""
    base = length.cast("double") / n
    margin = F.lit(float(overlap)) * base
    a = F.greatest(F.lit(0.0), i * base - margin / 2)
    z = F.least(length.cast("double"), (i + 1) * base + margin / 2)
    return F.rint(a).cast("long"), F.rint(z - a).cast("long")


def tile_plan(images: DataFrame, tile_px: Column | int, overlap: float = 0.25) -> DataFrame:
    """(image_id, tile_idx, x0, y0, w, h), row-major, for images(image_id, size_x, size_y)."""
    tile = F.greatest(F.lit(1.0), (F.lit(tile_px) if isinstance(tile_px, int) else tile_px).cast("double"))
    count = lambda length: F.greatest(F.lit(1), F.rint(length / tile).cast("int"))
    grid = images.select("image_id", "size_x", "size_y", count(F.col("size_x")).alias("nx"), count(F.col("size_y")).alias("ny"))
    cells = grid.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("ny") - 1))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)))
    x0, w = _span(F.col("i"), F.col("nx"), F.col("size_x"), overlap)
    y0, h = _span(F.col("j"), F.col("ny"), F.col("size_y"), overlap)
    return cells.select("image_id", (F.col("j") * F.col("nx") + F.col("i")).cast("long").alias("tile_idx"), x0.alias("x0"), y0.alias("y0"), w.alias("w"), h.alias("h"))


def tile_plan_resolved(requests: DataFrame, hosts: DataFrame, preview_px: int = 768) -> DataFrame:
    """The tile that a request gets: 0 or less means the whole image, none the preview size; hosts cap it.

    requests(image_id, size_x, size_y, tile_px, host_id); hosts(host_id, tile_cap_px).
    """
    long_side = F.greatest("size_x", "size_y")
    asked = F.coalesce("tile_px", F.lit(preview_px))
    capped = F.least(asked, F.col("tile_cap_px"))
    whole = (asked <= 0) | (capped >= long_side)
    tile = F.when(whole, long_side).otherwise(capped)
    return requests.join(F.broadcast(hosts), "host_id").select(
        "image_id", "host_id", whole.alias("whole"), tile.cast("long").alias("tile_px"), F.when(whole, 0.0).otherwise(0.25).alias("overlap"), (F.lit(1024.0) / F.greatest(tile, F.lit(1))).alias("upscale")
    )


def prompt_grid(tiles: DataFrame, pps: int, most: int | None = None) -> DataFrame:
    """pps x pps points of each tile, x fastest.

    For display, ``most`` thins them: beyond that number per tile every ceil(n / most)-th is kept.
    """
    n = pps * pps
    step = -(-n // most) if most and n > most else 1
    points = tiles.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(n - 1), F.lit(step))))
    i, j = F.col("p") % pps, F.expr(f"p div {pps}")
    return points.select("image_id", "tile_idx", F.col("p").cast("long").alias("point_idx"), (F.col("x0") + (i + 0.5) / pps * F.col("w")).alias("x"), (F.col("y0") + (j + 0.5) / pps * F.col("h")).alias("y"))


def crop_boxes(images: DataFrame, layers: int, ratio: float = 512 / 1500) -> DataFrame:
    """Overlapping crops of layers 1..n: 2**L by 2**L boxes each, i outer, j inner."""
    grown = images.withColumn("layer", F.explode(F.sequence(F.lit(1), F.lit(layers)))).withColumn("m", F.pow(F.lit(2), F.col("layer")).cast("int"))
    ov = F.lit(ratio) * F.least("size_x", "size_y") * 2 / F.col("m")
    size = lambda c: (F.col(c) + (F.col("m") - 1) * F.col("ov")) / F.col("m")
    grown = grown.withColumn("ov", ov).withColumn("cw", size("size_x")).withColumn("ch", size("size_y"))
    cells = grown.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    return cells.select(
        "image_id", F.col("layer").cast("long").alias("layer"), (F.col("i") * F.col("m") + F.col("j")).cast("long").alias("crop_idx"),
        (F.col("i") * (F.col("cw") - F.col("ov"))).alias("x0"), (F.col("j") * (F.col("ch") - F.col("ov"))).alias("y0"), F.col("cw").alias("w"), F.col("ch").alias("h"),
    )


def pass_count(requests: DataFrame, factor: int = 2) -> DataFrame:
    """Passes and prompts of a request(req_id, pps, crop_layers): (2**L)**2 crops per layer."""
    layers = F.sequence(F.lit(0), F.col("crop_layers").cast("int"))
    passes = F.aggregate(layers, F.lit(0.0), lambda s, k: s + F.pow(F.lit(4.0), k))
    side = lambda k: F.floor(F.col("pps") / F.pow(F.lit(float(factor)), k)).cast("double")
    prompts = F.aggregate(layers, F.lit(0.0), lambda s, k: s + F.pow(F.lit(4.0), k) * side(k) * side(k))
    return requests.select("req_id", passes.cast("long").alias("passes"), prompts.cast("long").alias("prompts"))


def overview_zoom(images: DataFrame, target: int) -> DataFrame:
    long_side = F.greatest("size_x", "size_y")
    return images.select("image_id", F.when(long_side <= target, 1.0).otherwise(F.lit(float(target)) / long_side).alias("zoom"))


def region_clamp(requests: DataFrame) -> DataFrame:
    """A requested box (x, y, w, h) within its image, at least one pixel wide and high."""
    low = lambda v, size: F.greatest(F.lit(0), F.least(F.col(v), F.col(size) - 1))
    x, y = low("x", "size_x"), low("y", "size_y")
    return requests.select("image_id", x.alias("x"), y.alias("y"), F.greatest(F.lit(1), F.least(F.col("w"), F.col("size_x") - x)).alias("w"), F.greatest(F.lit(1), F.least(F.col("h"), F.col("size_y") - y)).alias("h"))


def pyramid_levels(images: DataFrame, most_levels: int = 7, stop_px: int = 1500) -> DataFrame:
    """(image_id, level, size_x, size_y): halved until the first level with a long side of at most stop_px."""
    level = F.explode(F.sequence(F.lit(0), F.lit(most_levels - 1)))
    rows = images.select("image_id", F.col("size_x").alias("bx"), F.col("size_y").alias("by"), level.alias("level"))
    scaled = lambda c: F.greatest(F.lit(1), F.rint(F.col(c) * F.pow(F.lit(0.5), F.col("level"))).cast("long"))
    rows = rows.select("image_id", F.col("level").cast("long").alias("level"), scaled("bx").alias("size_x"), scaled("by").alias("size_y"))
    # the first level that is small enough, from the row itself: no earlier level may be so
    before = F.greatest(F.rint(F.col("bx") * F.pow(F.lit(0.5), F.col("level") - 1)), F.rint(F.col("by") * F.pow(F.lit(0.5), F.col("level") - 1)))
    base = images.select("image_id", F.col("size_x").alias("bx"), F.col("size_y").alias("by"))
    return rows.join(base, "image_id").where((F.col("level") == 0) | (before > stop_px)).select("image_id", "level", "size_x", "size_y")


def pyramid_plan(images: DataFrame, block: int = 3072, most_levels: int = 7, stop_px: int = 1500) -> DataFrame:
    """Blocks of each level with their source rectangle in full-size pixels."""
    rows = pyramid_levels(images, most_levels, stop_px)
    n = lambda c: F.ceil(F.col(c) / block).cast("int")
    cells = rows.withColumn("by", F.explode(F.sequence(F.lit(0), n("size_y") - 1))).withColumn("bx", F.explode(F.sequence(F.lit(0), n("size_x") - 1)))
    scale = F.pow(F.lit(2), F.col("level")).cast("long")
    w, h = F.least(F.lit(block), F.col("size_x") - F.col("bx") * block), F.least(F.lit(block), F.col("size_y") - F.col("by") * block)
    return cells.select("image_id", "level", F.col("bx").cast("long").alias("bx"), F.col("by").cast("long").alias("by"), w.alias("w"), h.alias("h"), (F.col("bx") * block * scale).alias("src_x"), (F.col("by") * block * scale).alias("src_y"), (w * scale).alias("src_w"), (h * scale).alias("src_h"))


def pyramid_rollup(pixels: DataFrame, levels: int) -> DataFrame:
    """Mean pixel value of each level's cells, from one scan."""
    grown = pixels.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    scale = F.pow(F.lit(2), F.col("level"))
    return grown.groupBy("image_id", F.col("level").cast("long").alias("level"), F.floor(F.col("x") / scale).alias("x"), F.floor(F.col("y") / scale).alias("y")).agg(F.avg("v").alias("v"), F.count("*").alias("n"))


def box_polygon(boxes: DataFrame) -> DataFrame:
    """Adds the four-corner polygon of (x0, y0, w, h)."""
    x0, y0, x1, y1 = F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h")
    return boxes.withColumn("polygon", F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1)))


def representative_tile(tiles: DataFrame, images: DataFrame, tile_px: int) -> DataFrame:
    """The tile whose centre is nearest the image's, the first on ties; the whole image if the tile is not smaller."""
    whole = (F.lit(tile_px) <= 0) | (F.lit(tile_px) >= F.greatest("size_x", "size_y"))
    dx, dy = F.col("x0") + F.col("w") / 2 - F.col("size_x") / 2, F.col("y0") + F.col("h") / 2 - F.col("size_y") / 2
    near = tiles.join(images.select("image_id", "size_x", "size_y"), "image_id").groupBy("image_id", "size_x", "size_y").agg(F.min_by(F.struct("x0", "y0", "w", "h", "tile_idx"), F.struct(dx * dx + dy * dy, "tile_idx")).alias("t"))
    pick = lambda c, other: F.when(whole, other).otherwise(F.col(f"t.{c}")).cast("long").alias(c)
    return near.select("image_id", pick("tile_idx", F.lit(0)), pick("x0", F.lit(0)), pick("y0", F.lit(0)), pick("w", F.col("size_x")), pick("h", F.col("size_y")))
