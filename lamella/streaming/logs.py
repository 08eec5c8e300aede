"""Detection logs as streams: parsing, live sections, progress, debounced edits, throughput.

Every function maps a DataFrame to a DataFrame and works on a stream as on a table; what
needs state across batches uses watermarks, or keyed state (``state``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .log_files import growing_lines
from .state import stream_edit_state as stream_edit_state

SECTION = "struct<poly: array<array<double>>, area: double>"
PAYLOAD = f"k long, n long, box array<long>, sections array<{SECTION}>"
#: Quiet gaps before a save, by kind of edit.
GAPS = {"edit": "1500 milliseconds", "frame": "500 milliseconds", "hover": "60 milliseconds", "camera": "400 milliseconds"}


def log_source(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of lines(run_id, ts, line) from text files, also of lines that are appended while the stream runs (``growing_lines``);
    run_id is the file's stem, or the value of its folder where that is named ``run_id=..``; ts is the file's modification time."""
    lines = growing_lines(spark, folder)
    stem = F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"\.[^.]*$", "")
    beneath = F.regexp_extract("path", r"/run_id=([^/]*)/[^/]*$", 1)
    return lines.select(F.when(beneath != "", beneath).otherwise(stem).alias("run_id"), F.col("modified").alias("ts"), F.col("value").alias("line"))


def parse_log(lines: DataFrame) -> DataFrame:
    """Events(run_id, ts, type, k, n, box, sections, tiles, text) of lines(run_id, ts, line, ...).

    Lines that start with STIM_TILES, STIM_TILE or STIM_TILESTART and a space hold JSON; broken JSON is
    dropped.  STIM_DONE and STIM_ERROR end a run; other lines are plain text; empty ones are dropped.
    """
    line = F.rtrim("line")
    head, rest = F.regexp_extract(line, r"^(STIM_TILES|STIM_TILESTART|STIM_TILE) (.*)$", 1), F.regexp_extract(line, r"^(STIM_TILES|STIM_TILESTART|STIM_TILE) (.*)$", 2)
    kind = F.when(head == "STIM_TILES", "tiles").when(head == "STIM_TILESTART", "start").when(head == "STIM_TILE", "tile").when(line.startswith("STIM_DONE"), "done").when(line.startswith("STIM_ERROR"), "error").otherwise("log")
    parsed = lines.where(line != "").withColumn("type", kind).withColumn("d", F.when(F.col("type").isin("start", "tile"), F.from_json(rest, PAYLOAD))).withColumn("tiles", F.when(F.col("type") == "tiles", F.from_json(rest, "array<array<long>>")))
    broken = (F.col("type").isin("start", "tile") & F.col("d.k").isNull()) | ((F.col("type") == "tiles") & F.col("tiles").isNull())
    keep = [c for c in lines.columns if c != "line"]
    return parsed.where(~broken).select(*keep, "type", "d.k", "d.n", "d.box", "d.sections", "tiles", F.when(F.col("type") == "log", line).alias("text"))


def live_sections(events: DataFrame) -> DataFrame:
    """(run_id, ts, k, idx, area, polygon) of confirmed sections with three vertices and more, to 0.1 pixel."""
    rows = events.where("type = 'tile'").select("run_id", "ts", "k", F.posexplode("sections").alias("idx", "s")).where(F.size("s.poly") >= 3)
    point = lambda p: F.struct(F.round(F.get(p, F.lit(0)), 1).alias("x"), F.round(F.get(p, F.lit(1)), 1).alias("y"))
    return rows.select("run_id", "ts", "k", F.col("idx").cast("long").alias("idx"), F.round("s.area", 1).alias("area"), F.transform("s.poly", point).alias("polygon"))


def progress(events: DataFrame) -> DataFrame:
    """Per run: tiles done and planned, sections so far, seconds left = elapsed / k * (n - k); elapsed is at least 1 ms.
    On a stream use the update or complete mode."""
    tiles = events.where("type = 'tile'")
    firm = F.size(F.filter("sections", lambda s: F.size(s["poly"]) >= 3))
    stats = tiles.groupBy("run_id").agg(F.max("k").alias("k"), F.max_by("n", "k").alias("n"), F.sum(firm).alias("n_sections"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    elapsed = F.greatest(F.lit(1e-3), (F.unix_micros(F.col("t1").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))) / 1e6)
    return stats.select("run_id", "k", "n", "n_sections", (elapsed / F.col("k") * (F.col("n") - F.col("k"))).alias("eta_s"))


def throughput(events: DataFrame, size: str = "1 minute", slide: str | None = None, lateness: str | None = "10 minutes") -> DataFrame:
    """Tiles and sections per time window; rows whose window ended ``lateness`` before the latest row are dropped.
    On a stream ``observe`` counts the tiles that were seen, as ``seen`` under the name ``tiles``."""
    tiles = events.where("type = 'tile'")
    tiles = tiles.observe("tiles", F.count("*").alias("seen")) if events.isStreaming else tiles
    tiles = tiles.withWatermark("ts", lateness) if lateness and events.isStreaming else tiles
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    firm = F.size(F.filter("sections", lambda s: F.size(s["poly"]) >= 3))
    return tiles.groupBy(w.alias("w")).agg(F.count("*").alias("tiles"), F.sum(firm).alias("sections")).select(F.col("w.start").alias("start"), "tiles", "sections")


def edit_debounce(edits: DataFrame, kind: str, lateness: str = "10 minutes") -> DataFrame:
    """One save per (image_id, burst of edits of this kind): the last value after a quiet gap.
    edits(image_id, ts, seq, kind, value).  On a stream ``observe`` counts the edits that were seen, as ``seen`` under the
    name ``edits``; those whose gap was over ``lateness`` before the latest edit are dropped."""
    rows = edits.where(F.col("kind") == kind)
    rows = rows.observe("edits", F.count("*").alias("seen")) if edits.isStreaming else rows
    rows = rows.withWatermark("ts", lateness) if edits.isStreaming else rows
    saved = rows.groupBy("image_id", F.session_window("ts", GAPS[kind]).alias("w")).agg(F.count("*").alias("n_edits"), F.max_by("value", "seq").alias("value"))
    return saved.select("image_id", F.col("w.start").alias("start"), "n_edits", "value")


def run_events(events: DataFrame) -> DataFrame:
    """Rows for ``ended_runs`` of ``parse_log``'s events: the live sections of each run, and a row with ``ended`` when it is done or fails."""
    rows = events.where("type in ('tile', 'done', 'error')")
    found = F.when(F.col("type") == "tile", F.col("sections")).otherwise(F.array(F.lit(None).cast(SECTION)))
    each = rows.select("run_id", "type", "k", F.posexplode(found).alias("idx", "s")).where((F.col("type") != "tile") | (F.size("s.poly") >= 3))
    ended = F.col("type") != "tile"
    mask = F.when(~ended, F.xxhash64("run_id", "k", "idx"))
    return each.select("run_id", ended.alias("ended"), mask.alias("mask_id"), F.when(~ended, F.col("k")).alias("k"), F.round("s.area", 1).alias("area"))
