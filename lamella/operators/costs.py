"""Run costs: host budgets, batches, estimates, model choice, ruler."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GIB = 1024.0**3
#: Fixed value: pixels per millimetre of the reference ruler at magnification 1.
RULER_PX_PER_MM = 125.28


def model_choice() -> Column:
    """Heaviest model variant for a host's device, ram_gb and vram_gb."""
    d, ram, vram = F.col("device"), F.col("ram_gb"), F.col("vram_gb")
    cuda = F.when(vram >= 10, "large").when(vram >= 6, "base_plus").otherwise("small")
    return F.when(d == "cuda", cuda).when(d == "mps", F.when(ram >= 16, "base_plus").otherwise("small")).otherwise(F.when(ram >= 24, "small").otherwise("tiny"))


def host_budget(hosts: DataFrame) -> DataFrame:
    """hosts(host_id, device, ram_gb, avail_gb, vram_gb, cores) with budget, batch, caps, threads and a summary line."""
    d, ram, avail, vram = F.col("device"), F.col("ram_gb"), F.col("avail_gb"), F.col("vram_gb")
    budget = (
        F.when((d == "cuda") & (vram > 0), 0.5 * vram)
        .when(d == "mps", F.greatest(F.lit(0.5), F.least(0.20 * avail, 0.15 * ram)))
        .otherwise(F.greatest(F.lit(0.6), 0.35 * avail))
    )
    tile = F.when(ram >= 24, 4096).when(ram >= 12, 3072).when(ram >= 8, 2048).otherwise(1536)
    out = hosts.withColumns({
        "model": model_choice(),
        "mem_budget_bytes": budget * GIB,
        "points_per_batch": F.when(d == "cuda", 64).when(d == "mps", 24).otherwise(12).cast("long"),
        "overview_cap_px": F.when(ram >= 24, 12000).when(ram >= 12, 9000).when(ram >= 8, 6000).otherwise(4096).cast("long"),
        "tile_cap_px": F.when(d == "cpu", F.least(tile, F.lit(2048))).otherwise(tile).cast("long"),
        "threads": F.greatest(F.lit(1), F.least(F.col("cores"), F.lit(8))).cast("long"),
    })
    line = F.format_string("%s, %d GB RAM, %s, batch %d, tiles %d px, overview %d px", "device", ram.cast("long"), F.col("model"), F.col("points_per_batch"), F.col("tile_cap_px"), F.col("overview_cap_px"))
    return out.withColumn("summary", line)


def safe_batch(requests: DataFrame) -> DataFrame:
    """Largest batch whose mask tensor fits the budget, for a tile grown by its overlap.

    requests(req_id, budget, requested, tile_px, overlap, size_x, size_y, masks_per_point).
    """
    side = lambda c: F.least(F.col(c), F.ceil(F.col("tile_px") * (1 + F.greatest(F.lit(0.0), F.col("overlap"))))).cast("double")
    per_point = F.greatest(F.lit(1.0), F.greatest(F.lit(1), F.col("masks_per_point")) * side("size_y") * side("size_x") * 4 * 1.2)
    cap = F.greatest(F.lit(1), F.floor(F.col("budget") / per_point))
    return requests.select("req_id", F.greatest(F.lit(1), F.least(F.col("requested"), cap)).cast("long").alias("batch"))


def run_estimate(plans: DataFrame, rates: DataFrame) -> DataFrame:
    """Seconds, minutes, peak memory and a warning for plans(req_id, device, model, pps, n_tiles, budget, avail_gb).

    A device that is not in rates counts as cpu, a model that is not there as 20 s a pass.
    """
    known = F.broadcast(rates.select("device").distinct().withColumnRenamed("device", "known"))
    rows = plans.join(known, F.col("device") == F.col("known"), "left").withColumn("rate_device", F.coalesce("known", F.lit("cpu")))
    cost = F.broadcast(rates.select(F.col("device").alias("rate_device"), "model", F.col("seconds").alias("rate")))
    rows = rows.join(cost, ["rate_device", "model"], "left")
    seconds = F.coalesce("rate", F.lit(20.0)) * F.greatest(F.lit(0.4), F.pow(F.greatest("pps", F.lit(1)) / 32.0, F.lit(1.3))) * F.greatest(F.lit(1), F.col("n_tiles"))
    rows = rows.withColumn("seconds", seconds).withColumn("peak_gb", F.col("budget") / GIB + 0.5)
    warning = F.when((F.col("device") == "cpu") & (F.col("seconds") > 180), "slow").when(F.col("peak_gb") > 0.8 * F.col("avail_gb"), "memory").otherwise("")
    return rows.select("req_id", "seconds", (F.col("seconds") / 60).alias("minutes"), "peak_gb", warning.alias("warning"))


def effect_readout(settings: DataFrame) -> DataFrame:
    """Tiles by the step rule, and the size at which a section reaches the model.

    settings(image_id, size_x, size_y, tile_px, overlap, section_px).
    """
    long_side = F.greatest("size_x", "size_y")
    eff = F.when(F.col("tile_px") > 0, F.col("tile_px")).otherwise(long_side)
    step = F.greatest(F.lit(1.0), eff * (1 - F.col("overlap")))
    tiles = F.when(eff >= long_side, 1).otherwise((F.ceil(F.col("size_y") / step) * F.ceil(F.col("size_x") / step)).cast("long"))
    return settings.select("image_id", tiles.cast("long").alias("n_tiles"), (F.col("section_px") * 1024.0 / F.greatest(eff, F.lit(1))).alias("apparent_px"))


def model_resolve(requests: DataFrame, inventory: DataFrame) -> DataFrame:
    """The checkpoint that serves a request(req_id, preference, host_model, active): the preferred variant's
    file if it is in inventory(file), else the active one with a flag."""
    variant = F.when(F.col("preference").isin("Auto", ""), F.col("host_model")).otherwise(F.col("preference"))
    rows = requests.withColumn("variant", variant).withColumn("want", F.concat(F.lit("sam2.1_hiera_"), variant, F.lit(".pt")))
    have = F.broadcast(inventory.select(F.col("file").alias("want"), F.lit(True).alias("here")))
    rows = rows.join(have, "want", "left")
    return rows.select("req_id", "variant", F.when(F.col("here"), F.col("want")).otherwise(F.col("active")).alias("checkpoint"), (F.col("here").isNull() & ~F.contains("active", "variant")).alias("fell_back"))


def model_config(files: DataFrame) -> DataFrame:
    """Configuration file and family of checkpoint files(file); file names and letters are fixed values."""
    name = F.lower(F.regexp_extract("file", r"([^/]*)$", 1))
    has = lambda *parts: F.greatest(*[name.contains(p) for p in parts], F.lit(False))
    letter = F.when(has("tiny"), "t").when(has("small"), "s").when(has("base_plus", "b+", "bplus"), "b+").when(has("large"), "l").otherwise("b+")
    return files.select("file", F.concat(F.lit("configs/sam2.1/sam2.1_hiera_"), letter, F.lit(".yaml")).alias("config"), (name.endswith(".pt") | name.contains("sam2")).alias("new_family"))


def ruler(measurements: DataFrame) -> DataFrame:
    """Length in mm of (x1, y1)-(x2, y2) at magnification mag, and its ratio to original_mm."""
    mm = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / (RULER_PX_PER_MM * F.col("mag"))
    return measurements.select("meas_id", mm.alias("mm"), (mm / F.nullif("original_mm", F.lit(0.0))).alias("ratio"))
