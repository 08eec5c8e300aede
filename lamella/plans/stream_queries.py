"""Queries of the log and edit operators: streams over files, and the same functions over event tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from ..functions.lineage import work_folder
from ..operators import clustering, filters
from ..streaming import log_files, logs, state, tables
from ..streaming.counts import ObservedCounts
from .filter_queries import bands
from .registry import query
from .spatial_queries import IN_BAND

LINES = """select user_id as run_id, ts, event_id,
    case event_type when 'view' then 'STIM_TILE {"k": ' || (event_id % 9 + 1) || ', "n": 9, "box": [0, 0, 10, 10], "sections": [{"poly": [[1.04, 2], [3, 4.26], [5, 6]], "area": ' || (event_id % 100) || '.25}, {"poly": [[1, 2]], "area": 3.0}]}'
      when 'click' then 'STIM_TILESTART {"k": ' || (event_id % 9 + 1) || case when event_id % 3 = 0 then ', "n' else ', "n": 9, "box": [1, 2, 3, 4]}' end
      when 'signup' then 'STIM_TILES [[0, 0, 5, 5], [5, 0, 5, 5]]' when 'purchase' then 'STIM_DONE: 4 sections' when 'error' then 'STIM_ERROR: x' else '' end as line from events"""


def _lines():
    return (LINES.replace("from events", "from {events}").replace('{"', '{{"').replace('"area": 3.0}]}', '"area": 3.0}}]}}').replace(".25}", ".25}}").replace("[1, 2, 3, 4]}", "[1, 2, 3, 4]}}"))


def _events(fx):
    return logs.parse_log(fx.spark.sql(_lines(), events=fx.events))


PARSED = "with e as (select user_id as run_id, ts, event_id, event_type as t, event_id % 9 + 1 as k, event_id % 3 = 0 as bad from events)"
TYPES = "select run_id, event_id, case t when 'view' then 'tile' when 'click' then 'start' when 'signup' then 'tiles' when 'purchase' then 'done' else 'error' end as type, case when t in ('view', 'click') then k end as k, case when t in ('view', 'click') then cast(9 as bigint) end as n, case t when 'view' then cast(2 as bigint) end as n_sections, case t when 'signup' then cast(2 as bigint) end as n_tiles from e where t in ('view', 'click', 'signup', 'purchase', 'error') and not (t = 'click' and bad)"


def _shown(events):
    n = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).cast("long")
    return events.select("run_id", "event_id", "type", "k", "n", n("sections").alias("n_sections"), n("tiles").alias("n_tiles"))


def _run(writer, path):
    """Runs a stream until its source is read, however long that takes; an error in it is raised here."""
    ask = writer.option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start()
    try:
        ask.awaitTermination()
    finally:
        ask.stop()
    return ask


def _followed(stream, schema, path):
    """The rows that a stream gives until its source is read, written as a table; called again it goes on."""
    ask = _run(stream.writeStream.format("parquet").option("path", f"{path}/rows"), path)
    return stream.sparkSession.read.schema(schema).parquet(f"{path}/rows"), ask


#: What a log file holds when the stream looks at it: part of its lines and half of the next one, then all of them;
#: where the run's number is divisible by 5 the file is started anew with the lines that are left.
ONE_IN = 5


def _write_logs(lines, folder: str, step: int):
    """The log files of all runs at this step, written whole each time, so that a repeated task writes the same."""

    def texts(run: int, said: list[str]) -> str:
        half = len(said) // 2
        if step == 0:
            return "".join(x + "\n" for x in said[:half]) + (said[half][: len(said[half]) // 2] if run % ONE_IN else "")
        return "".join(x + "\n" for x in (said if run % ONE_IN else said[half:]))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, top = log_files.filesystem(folder)
        for batch in batches:
            for run, said in zip(batch["run_id"].tolist(), batch["said"], strict=True):
                path = f"{top}/run_id={run}"
                system.create_dir(path)
                with system.open_output_stream(f"{path}/run.log") as f:
                    f.write(texts(int(run), list(said)).encode())
            yield pd.DataFrame({"n": [len(batch)]})

    # a row per run, as a file is; many runs meet in a task without a group of their own
    said = F.transform(F.sort_array(F.collect_list(F.struct("event_id", "line"))), lambda e: e["line"])
    runs = lines.groupBy("run_id").agg(said.alias("said"))
    return runs.mapInPandas(write, "n long").agg(F.sum("n")).first()[0]


@query("detection_log_source", PARSED + ", l as (" + TYPES + ") select cast(run_id as varchar) as run_id, type, count(*) as n_lines, sum(k) as sum_k, sum(n_sections) as n_sections, sum(n_tiles) as n_tiles from l group by run_id, type")
def detection_log_source(fx):
    """Log files, one a run, followed as a stream while they are written: twice half, with a line cut in the middle, and a fifth of them started anew."""
    folder, path = work_folder(fx.spark, "logs"), work_folder(fx.spark, "log-events")
    lines = fx.spark.sql(_lines(), events=fx.events).select("run_id", "event_id", "line")
    for step in (0, 1):
        _write_logs(lines, folder, step)
        events = logs.parse_log(logs.log_source(fx.spark, folder)).drop("ts")
        rows, _ = _followed(events, events.schema, path)
    n = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).cast("long")
    shown = rows.select("run_id", "type", "k", n("sections").alias("n_sections"), n("tiles").alias("n_tiles"))
    return shown.groupBy("run_id", "type").agg(F.count("*").alias("n_lines"), F.sum("k").alias("sum_k"), F.sum("n_sections").alias("n_sections"), F.sum("n_tiles").alias("n_tiles"))


def _arriving(fx, rows, part, name):
    """Runs of a stream over ``rows`` in the order of ``part`` (0, 1, ..), one part a run: yields the stream, to be started each time."""
    folder = work_folder(fx.spark, name)
    n = rows.agg(F.max(part)).first()[0]
    for p in range((n if n is not None else -1) + 1):
        rows.where(part == p).write.mode("append").parquet(folder)
        yield fx.spark.readStream.schema(rows.schema).parquet(folder)


@query("stream_parse", PARSED + TYPES)
def stream_parse(fx):
    return _shown(_events(fx))


@query("stream_live_sections", PARSED + " select run_id, k, round(event_id % 100 + 0.25e0, 1) as area, cast(3 as bigint) as n_points, 1.0e0 as x0, 4.3e0 as y1 from e where t = 'view'")
def stream_live_sections(fx):
    return logs.live_sections(_events(fx)).select("run_id", "k", "area", F.size("polygon").cast("long").alias("n_points"), F.element_at("polygon", 1)["x"].alias("x0"), F.element_at("polygon", 2)["y"].alias("y1"))


@query("stream_progress", PARSED + " select run_id, max(k) as k, cast(9 as bigint) as n, count(*) as n_sections, round(greatest(0.001e0, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) / max(k) * (9 - max(k)), 3) as eta_s from e where t = 'view' group by run_id")
def stream_progress(fx):
    """Log lines in three parts as a stream in update mode, whose rows are put into a table by run."""
    path = work_folder(fx.spark, "progress")
    lines = fx.spark.sql(_lines(), events=fx.events)
    put, table = tables.upsert_into(f"{path}/table", ["run_id"], every=2), logs.progress(_events(fx))
    for stream in _arriving(fx, lines, F.col("event_id") % 3, "progress-lines"):
        _run(logs.progress(logs.parse_log(stream)).writeStream.outputMode("update").foreachBatch(put), path)
    return tables.upserted(fx.spark, f"{path}/table", table.schema, ["run_id"]).withColumn("eta_s", F.round("eta_s", 3))


#: Rows that come last: every ninth event, in a part of its own after all others; late if their window was over ten minutes before the latest of these.
LATE = """parts as (select *, case when event_id % 9 = 4 then 1 else 0 end as part from {rows}), mark as (select epoch_us(max(ts)) // 1000 * 1000 - 600000000 as wm from parts where part = 0)"""
LATER_S = 86_400


def _parted(rows, sentinel):
    """rows with their ``part``, and a row a day after all others, alone in the last part, which closes all windows."""
    last = rows.agg((F.max("ts") + F.expr(f"interval {LATER_S} seconds")).alias("ts"), F.lit(2).alias("part"))
    names = [c for c in rows.columns if c != "ts"]
    closing = last.where("ts is not null").select("ts", *[sentinel.get(c, F.lit(None)).cast(rows.schema[c].dataType).alias(c) for c in names], "part")
    return rows.withColumn("part", F.when(F.col("event_id") % 9 == 4, 1).otherwise(0)).unionByName(closing.select(*rows.columns, "part"))


def _counted(fx, rows, name, make, schema):
    """Rows of the stream ``make(stream)`` over the parts of ``rows``, and how many it has seen under ``name``."""
    path, heard = work_folder(fx.spark, name), ObservedCounts(name)
    fx.spark.streams.addListener(heard)
    try:
        for stream in _arriving(fx, rows, F.col("part"), f"{name}-rows"):
            out, ask = _followed(make(stream), schema, path)
            heard.wait(ask.runId)
    finally:
        fx.spark.streams.removeListener(heard)
    return (out if heard.sums else fx.spark.createDataFrame([], schema)), heard.sums["seen"]


@query(
    "tile_throughput",
    PARSED + ", rows as (select * from e where t = 'view'), " + LATE.replace("{rows}", "rows") + """,
    w as (select *, time_bucket(interval 5 minutes, ts, timestamp '1970-01-01') - to_minutes(5 * j) as start from parts, range(2) as r(j)),
    seen as (select *, part = 1 and epoch_us(start) + 600000000 <= wm as late from w, mark)
    select cast(epoch_us(start) // 1000000 as bigint) as start_s, count(*) as tiles, count(*) as sections, (select count(*) from seen) as rows_seen, (select count(*) from seen where late) as rows_late from seen where not late group by start""",
)
def tile_throughput(fx):
    """Tiles per ten minutes, every five, as a stream whose last rows come late; a tile counts in two windows."""
    lines = _parted(fx.spark.sql(_lines(), events=fx.events).select("run_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "line"), {"line": F.lit('STIM_TILE {"k": 1, "n": 1, "box": [0, 0, 1, 1], "sections": []}')})
    make = lambda stream: logs.throughput(logs.parse_log(stream), "10 minutes", "5 minutes").select(F.unix_seconds("start").alias("start_s"), "tiles", "sections")
    out, seen = _counted(fx, lines, "tiles", make, "start_s long, tiles long, sections long")
    told = out.agg(F.coalesce(F.sum("tiles"), F.lit(0)).alias("told"))
    pairs = 2 * max(seen - 1, 0)  # without the closing row
    return out.crossJoin(F.broadcast(told)).select("start_s", "tiles", "sections", F.lit(pairs).cast("long").alias("rows_seen"), (F.lit(pairs) - F.col("told")).alias("rows_late"))


@query(
    "edit_debounce",
    "with r as (select user_id % 20 as image_id, ts, event_id, event_id as seq, value from events), " + LATE.replace("{rows}", "r") + """,
    judged as (select *, part = 1 and epoch_us(ts) + 1500000 <= wm as late from parts, mark), e as (select * from judged where not late),
    g as (select *, case when lag(ts) over (partition by image_id order by ts, seq) is null or epoch_us(ts) - epoch_us(lag(ts) over (partition by image_id order by ts, seq)) > 1500000 then 1 else 0 end as fresh from e),
    s as (select *, sum(fresh) over (partition by image_id order by ts, seq) as sid from g)
    select image_id, cast(epoch_us(min(ts)) as bigint) as start_us, count(*) as n_edits, arg_max(value, seq) as value, (select count(*) from judged) as rows_seen, (select count(*) from judged where late) as rows_late from s group by image_id, sid""",
)
def edit_debounce(fx):
    """Bursts of edits as session windows of a stream whose last rows come late."""
    rows = fx.events.select((F.col("user_id") % 20).alias("image_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_id").alias("seq"), F.lit("edit").alias("kind"), "value")
    rows = _parted(rows, {"image_id": F.lit(-1), "seq": F.lit(0), "kind": F.lit("edit")})
    make = lambda stream: logs.edit_debounce(stream, "edit").select("image_id", F.unix_micros("start").alias("start_us"), "n_edits", "value")
    out, seen = _counted(fx, rows, "edits", make, "image_id long, start_us long, n_edits long, value double")
    told = out.agg(F.coalesce(F.sum("n_edits"), F.lit(0)).alias("told"))
    real = max(seen - 1, 0)
    return out.crossJoin(F.broadcast(told)).select("image_id", "start_us", "n_edits", "value", F.lit(real).cast("long").alias("rows_seen"), (F.lit(real) - F.col("told")).alias("rows_late"))


EDITS = "select user_id as image_id, event_id as seq, event_id % 40 as key, case event_type when 'error' then 'remove' else 'add' end as op, value, ts from {events}"


@query("stream_edit_state", "with e as (" + EDITS + "), l as (select *, row_number() over (partition by image_id, key order by seq desc) as rn from e) select image_id, key, op, value, op <> 'remove' as present from l where rn = 1")
def stream_edit_state(fx):
    """Edits in three parts as a stream with state by key; what changes is put into a table by key."""
    edits, keys, path = fx.spark.sql(EDITS, events=fx.events).withColumn("ts", F.col("ts").cast("timestamp")), ["image_id", "key"], work_folder(fx.spark, "edit-state")
    put = tables.upsert_into(f"{path}/table", keys, "seq", every=2)
    with state.keyed_state(fx.spark):
        # parts in the order of time: none comes late
        a, z = (edits.agg(F.percentile_approx(F.unix_micros("ts"), [1 / 3, 2 / 3]).alias("p")).first()["p"] or [0, 0])
        for stream in _arriving(fx, edits.withColumn("part", (F.unix_micros("ts") > a).cast("int") + (F.unix_micros("ts") > z).cast("int")), F.col("part"), "edits"):
            live = state.stream_edit_state(stream)
            _run(live.writeStream.outputMode("update").foreachBatch(put), path)
    schema = state.stream_edit_state(edits).schema
    return tables.upserted(fx.spark, f"{path}/table", schema, keys, "seq").drop("seq")


DEDUP = """with recursive r as (select *, row_number() over (partition by image_id order by tile_idx, area desc, mask_id) as rk from {detections}),
    g as (select image_id, cast(0 as bigint) as rk, cast([] as struct(x double, y double)[]) as kept, cast(null as bigint) as mask_id, false as ok from (select distinct image_id from r)
      union all select g.image_id, r.rk, case when len(list_filter(g.kept, lambda e: abs(r.cx - e.x) < 0.5e0 * sqrt(greatest(r.area, 1)) and abs(r.cy - e.y) < 0.5e0 * sqrt(greatest(r.area, 1)))) > 0 then g.kept else list_append(g.kept, struct_pack(x := r.cx, y := r.cy)) end, r.mask_id,
        len(list_filter(g.kept, lambda e: abs(r.cx - e.x) < 0.5e0 * sqrt(greatest(r.area, 1)) and abs(r.cy - e.y) < 0.5e0 * sqrt(greatest(r.area, 1)))) = 0 from g join r on r.image_id = g.image_id and r.rk = g.rk + 1)
    select cast(image_id as varchar) as run_id, mask_id from g where ok"""


@query("stream_dedup", DEDUP)
def stream_dedup(fx):
    """Tiles of all runs as files of a stream, a few a batch; the state per run resolves them in their order."""
    cols = ["run_id", "k", "mask_id", "x", "y", "area", "last"]
    found = fx.detections.select(F.col("image_id").cast("string").alias("run_id"), F.col("tile_idx").alias("k"), "mask_id", F.col("cx").alias("x"), F.col("cy").alias("y"), "area", F.lit(False).alias("last"))
    none = F.lit(0.0)
    told = found.select("run_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))))
    told = told.select("run_id", "k", F.lit(None).cast("long").alias("mask_id"), none.alias("x"), none.alias("y"), none.alias("area"), (F.col("k") == 8).alias("last"))
    folder = work_folder(fx.spark, "tiles")
    # every third tile to one file, so that a run's tiles come in several batches and not in order
    found.select(*cols).union(told.select(*cols)).repartition(3, F.pmod("k", F.lit(3))).write.parquet(folder)
    stream = fx.spark.readStream.schema(found.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    with state.keyed_state(fx.spark):
        kept, _ = _followed(state.stream_dedup(stream), state.KEPT, work_folder(fx.spark, "kept"))
    return kept.select("run_id", "mask_id")


#: Runs that are not over yet, and rows that come after their run's end.
OPEN, AFTER = "image_id % 13 = 5", "mask_id % 40 = 7"
ENDED = IN_BAND.replace("where pred_iou > 0.3", f"where pred_iou > 0.3 and not ({OPEN}) and not ({AFTER})")


@query("stream_finalize", "with " + ENDED + f" select image_id, mask_id, false as late from kept union all select image_id, mask_id, true as late from {{detections}} where pred_iou > 0.3 and not ({OPEN}) and {AFTER}")
def stream_finalize(fx):
    """Sections of all runs as a stream, then the ends of most runs, then rows that are too late; what ends is put in its band and clustered."""
    path = work_folder(fx.spark, "final")
    found = fx.detections.where("pred_iou > 0.3").select(F.col("image_id").alias("run_id"), "mask_id", "area", F.when(F.expr(AFTER), 3).otherwise(F.col("mask_id") % 2).cast("int").alias("part"), F.lit(False).alias("ended"))
    ends = fx.detections.where(f"not ({OPEN})").select(F.col("image_id").alias("run_id")).distinct().select("run_id", F.lit(None).cast("long").alias("mask_id"), F.lit(None).cast("double").alias("area"), F.lit(2).alias("part"), F.lit(True).alias("ended"))
    limits = bands(fx)

    def finalize(rows):
        masks = rows.select(F.col("run_id").alias("image_id"), "mask_id", F.col("mask_id").alias("idx"), "area")
        return clustering.finalize_sections(filters.size_band(masks, limits)).select("image_id", "mask_id")

    with state.keyed_state(fx.spark):
        for stream in _arriving(fx, found.unionByName(ends), F.col("part"), "sections"):
            _run(state.ended_runs(stream.drop("part")).writeStream.foreachBatch(tables.finalize_into(path, finalize)), path)
    final = tables.read_epochs(fx.spark, f"{path}/final", "image_id long, mask_id long").withColumn("late", F.lit(False))
    late = tables.read_epochs(fx.spark, f"{path}/late", "run_id long, mask_id long, area double").select(F.col("run_id").alias("image_id"), "mask_id", F.lit(True).alias("late"))
    return final.unionByName(late)
