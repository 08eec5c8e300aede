"""Edits, caches and set comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Rows of levels, which one task counts in a table of its own.
TASK_ROWS = 1 << 20


def edit_replay(events: DataFrame) -> DataFrame:
    """State after events(image_id, key, seq, op, value): the last event of each key counts; keys whose last
    event removes them are gone (removing what is not there changes nothing)."""
    last = events.groupBy("image_id", "key").agg(F.max_by(F.struct("op", "value", "seq"), "seq").alias("e"))
    return last.where("e.op <> 'remove'").select("image_id", "key", "e.op", "e.value", "e.seq")


def run_key() -> object:
    """Cache key of a request: image, model, long side, points per side, crop layers, least area, iou."""
    return F.concat_ws("|", "image_id", "model", "long_side", "pps", "crop_layers", "min_area", "iou")


def run_cache_lookup(requests: DataFrame, cached: DataFrame) -> DataFrame:
    """Requests whose key is not cached, each key once (the least req_id)."""
    asked = requests.withColumn("cache_key", run_key())
    return asked.join(cached.select(run_key().alias("cache_key")).distinct(), "cache_key", "left_anti").groupBy("cache_key").agg(F.min("req_id").alias("req_id"))


def pyramid_freshness(manifests: DataFrame, levels: DataFrame, sources: DataFrame) -> DataFrame:
    """(image_id, fresh): complete, every level there, and size and whole mtime as the source's."""
    # the number of parts follows the rows, so that what a task counts stays as large as it is
    parts = max(int(levels.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-levels.count() // TASK_ROWS))
    dealt = manifests.repartition(parts, "image_id")
    have = levels.where(F.col("level") >= 0).repartition(parts, "image_id").join(dealt.select("image_id", "n_levels"), "image_id").where("level < n_levels").groupBy("image_id").agg(F.countDistinct("level").alias("have"))
    told = sources.select("image_id", F.col("size").alias("s"), F.floor("mtime").alias("t")).repartition(parts, "image_id")
    rows = dealt.join(have, "image_id", "left").join(told, "image_id", "left")
    fresh = F.col("complete") & (F.coalesce("have", F.lit(0)) == F.col("n_levels")) & (F.col("size") == F.col("s")) & (F.floor("mtime") == F.col("t"))
    return rows.select("image_id", F.coalesce(fresh, F.lit(False)).alias("fresh"))


def before_after_pairs(before: DataFrame, after: DataFrame, rows: int) -> DataFrame:
    """(name, idx, tbl, row) of the png names in both listings(folder, name), sorted; idx counts within a folder."""
    png = lambda df: df.where(F.lower("name").endswith(".png")).select("folder", "name").distinct()
    both = png(before).join(png(after), ["folder", "name"])
    idx = F.row_number().over(Window.partitionBy("folder").orderBy("name")) - 1
    return both.withColumn("idx", idx.cast("long")).withColumn("tbl", F.expr(f"idx div {rows}")).withColumn("row", F.col("idx") % rows)


def raw_vs_kept(raw: DataFrame, kept: DataFrame) -> DataFrame:
    """(image_id, mask_id, side): in the raw layer only, in the kept one only, or in both."""
    a, b = raw.select("image_id", "mask_id").distinct(), kept.select("image_id", "mask_id").distinct()
    tag = lambda df, side: df.withColumn("side", F.lit(side))
    return tag(a.exceptAll(b), "raw").union(tag(b.exceptAll(a), "kept")).union(tag(a.intersect(b), "both"))


def rle_stats(masks: DataFrame) -> DataFrame:
    """Area and box of masks(image_id, mask_id, height, runs): alternating off and on runs, column by column."""
    runs = masks.select("image_id", "mask_id", "height", F.posexplode("runs").alias("k", "run"))
    w = Window.partitionBy("image_id", "mask_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.withColumn("end", F.sum("run").over(w)).withColumn("start", F.col("end") - F.col("run"))
    on = runs.where((F.col("k") % 2 == 1) & (F.col("run") > 0))
    col0, col1 = F.expr("start div height"), F.expr("(end - 1) div height")
    many = F.col("c0") < F.col("c1")  # a run over a column border touches top and bottom
    on = on.withColumn("c0", col0).withColumn("c1", col1)
    on = on.withColumn("r0", F.when(many, 0).otherwise(F.col("start") % F.col("height"))).withColumn("r1", F.when(many, F.col("height") - 1).otherwise((F.col("end") - 1) % F.col("height")))
    return on.groupBy("image_id", "mask_id").agg(F.sum("run").alias("area"), F.min("c0").alias("x0"), F.min("r0").alias("y0"), (F.max("c1") + 1).alias("x1"), (F.max("r1") + 1).alias("y1"))
