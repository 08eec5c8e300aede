"""Streams give what tables give, however the rows are cut into batches."""

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lamella.plans.fixtures import Fixtures
from lamella.streaming import log_files, logs, state, tables
from lamella.streaming.counts import ObservedCounts

LINES = [
    (1, "STIM_TILES [[0, 0, 5, 5]]"), (2, 'STIM_TILESTART {"k": 1, "n": 2, "box": [0, 0, 5, 5]}'),
    (3, 'STIM_TILE {"k": 1, "n": 2, "box": [0, 0, 5, 5], "sections": [{"poly": [[0, 0], [1, 0], [1, 1]], "area": 0.5}]}'),
    (4, "STIM_TILE {broken"), (5, "STIM_PROGRESS: 2 tiles"), (6, ""), (9, 'STIM_TILE {"k": 2, "n": 2, "box": [0, 0, 5, 5], "sections": []}'), (10, "STIM_DONE: 1 sections"),
]


def lines(spark):
    return spark.createDataFrame([("r", t, x) for t, x in LINES], "run_id string, s long, line string").select("run_id", F.timestamp_seconds("s").alias("ts"), "line")


def run(spark, df, out, parts, path, mode="append"):
    """Writes df in files, reads them as a stream of one file a batch, returns the rows of out(stream)."""
    df.repartitionByRange(parts, df.columns[0]).sortWithinPartitions(*df.columns).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    name = f"t{abs(hash(str(path)))}"
    with state.keyed_state(spark):
        q = out(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{path}/check").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_parse(spark):
    rows = {r.type: r for r in logs.parse_log(lines(spark)).collect()}
    assert sorted(r.type for r in logs.parse_log(lines(spark)).collect()) == ["done", "log", "start", "tile", "tile", "tiles"]
    assert rows["log"].text == "STIM_PROGRESS: 2 tiles" and rows["start"].box == [0, 0, 5, 5]
    p = logs.progress(logs.parse_log(lines(spark))).first()
    assert (p.k, p.n, p.n_sections, p.eta_s) == (2, 2, 1, 0.0)


@pytest.mark.parametrize("parts", [1, 3])
def test_live_sections_on_a_stream(spark, tmp_path, parts):
    got = run(spark, lines(spark), lambda s: logs.live_sections(logs.parse_log(s)), parts, tmp_path).collect()
    assert [(r.k, r.area) for r in got] == [(1, 0.5)]


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_stream_dedup_equals_the_table(spark, small, tmp_path, parts):
    d = Fixtures(spark, small).detections.where("image_id % 10 < 3")
    rows = d.select(F.col("tile_idx").alias("k"), F.col("image_id").cast("string").alias("run_id"), "mask_id", F.col("cx").alias("x"), F.col("cy").alias("y"), "area", F.lit(False).alias("last"))
    runs = rows.select("run_id").distinct()
    every = runs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(8)))).select(F.col("k").cast("long").alias("k"), "run_id", F.lit(None).cast("long").alias("mask_id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("area"), (F.col("k") == 8).alias("last"))  # every tile is told
    both = rows.union(every)
    want = {(r.run_id, r.mask_id) for r in state.stream_dedup(rows).collect()}
    got = {(r.run_id, r.mask_id) for r in run(spark, both, state.stream_dedup, parts, tmp_path).collect()}
    assert got == want and want


def test_stream_dedup_keeps_what_a_failed_run_has(spark, tmp_path):
    rows = [(2, "r", 1, 0.0, 0.0, 100.0, False), (0, "r", 2, 50.0, 50.0, 100.0, False), (2, "r", 3, 1.0, 1.0, 90.0, False), (None, "r", None, 0.0, 0.0, 0.0, True)]
    df = spark.createDataFrame(rows, "k long, run_id string, mask_id long, x double, y double, area double, last boolean")
    got = run(spark, df, state.stream_dedup, 1, tmp_path).collect()
    assert sorted(r.mask_id for r in got) == [1, 2]


def test_debounce_gaps(spark, tmp_path):
    at = [0.0, 1.4, 3.0, 4.6]  # 1.4 s apart, then 1.6 s
    df = spark.createDataFrame([(1, t, i, "edit", f"v{i}") for i, t in enumerate(at)], "image_id long, s double, seq long, kind string, value string")
    df = df.select("image_id", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("ts"), "seq", "kind", "value")
    assert sorted((r.n_edits, r.value) for r in logs.edit_debounce(df, "edit").collect()) == [(1, "v2"), (1, "v3"), (2, "v1")]
    got = run(spark, df, lambda s: logs.edit_debounce(s, "edit"), 1, tmp_path, mode="complete").collect()
    assert sorted((r.n_edits, r.value) for r in got) == [(1, "v2"), (1, "v3"), (2, "v1")]


def follow(spark, stream, path, batch=None, mode="append"):
    """What a stream gives until its source is read; called again it goes on."""
    with state.keyed_state(spark):
        w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/check").trigger(availableNow=True)
        q = w.foreachBatch(batch).start() if batch else w.format("parquet").option("path", f"{path}/out").start()
        q.awaitTermination()
    return q


def test_lines_of_growing_files_come_once(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "run_id=r7").mkdir(parents=True)
    log, other = folder / "run_id=r7" / "a.log", folder / "b.log"
    told = lambda: sorted((r.run_id, r.line) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = []

    def step(*new):
        follow(spark, logs.log_source(spark, str(folder)).drop("ts"), tmp_path)
        want.extend(new)
        assert told() == sorted(want)

    log.write_text("one\ntwo\nthr")
    step(("r7", "one"), ("r7", "two"))
    with log.open("a") as f:
        f.write("ee\n\nfour é\n")
    other.write_text("no line yet")
    (folder / "_hidden.log").write_text("x\n")
    step(("r7", "three"), ("r7", ""), ("r7", "four é"))
    step()
    log.write_text("anew\n")  # started anew, shorter
    with other.open("a") as f:
        f.write(", now\n")
    step(("r7", "anew"), ("b", "no line yet, now"))
    log.write_text("other bytes, and longer than before\n" * 3)
    step(*[("r7", "other bytes, and longer than before")] * 3)
    other.unlink()
    step()


def test_many_short_files_are_read_by_few_tasks(tmp_path):
    for n in range(300):
        (tmp_path / f"r{n}.log").write_text(f"a{n}\nb{n}\n")
    reader = log_files.GrowingReader(str(tmp_path), log_files.TASK_BYTES)
    parts = reader.partitions({}, reader.latestOffset())
    got = [(c["path"].rsplit("/", 1)[1], c["value"]) for p in parts for b in reader.read(p) for c in b.to_pylist()]
    assert len(parts) == 1 and sorted(got) == sorted((f"r{n}.log", f"{x}{n}") for n in range(300) for x in "ab")


@pytest.mark.parametrize("size", [1, 3, 7, 64])
def test_pieces_of_a_file_share_its_lines(tmp_path, size):
    path = tmp_path / "x.log"
    lines = ["", "a", "bb" * 9, "", "ccc", "dé" * 4]
    path.write_text("\n".join(lines) + "\nhalf")
    reader = log_files.GrowingReader(str(tmp_path), size)
    end = reader.latestOffset()
    got = [v for p in reader.partitions({}, end) for b in reader.read(p) for v in b.column("value").to_pylist()]
    assert got == lines and end["x.log"]["end"] == path.stat().st_size - 4
    assert reader.partitions(end, end) == []


def test_ended_runs_are_finalised_once_and_leave_the_state(spark, tmp_path):
    schema = "run_id string, ended boolean, mask_id long, area double"
    parts = [[("a", False, 1, 5.0), ("b", False, 2, None)], [("a", False, 3, 1.0)], [("a", True, None, None), ("c", True, None, None)], [("a", False, 4, 2.0), ("b", False, 5, 1.0)], [("b", True, None, None)]]
    path, seen = str(tmp_path / "t"), []

    def finalize(rows):
        seen.append(sorted((r.run_id, r.mask_id, r.area) for r in rows.collect()))
        return rows.groupBy("run_id").agg(F.count("*").alias("n"))

    put = tables.finalize_into(path, finalize)
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = follow(spark, state.ended_runs(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), tmp_path, put)
        held = [o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]]
        assert not held or held[-1] <= 4
    assert seen == [[("a", 1, 5.0), ("a", 3, 1.0)], [("b", 2, None), ("b", 5, 1.0)]]
    assert sorted((r.run_id, r.n) for r in tables.read_epochs(spark, f"{path}/final", "run_id string, n long").collect()) == [("a", 2), ("b", 2)]
    assert [(r.run_id, r.mask_id) for r in tables.read_epochs(spark, f"{path}/late", "run_id string, mask_id long, area double").collect()] == [("a", 4)]
    again = spark.createDataFrame([("a", 1, 5.0, False), ("a", 3, 1.0, False)], "run_id string, mask_id long, area double, late boolean")
    put(again, 2)  # a repeated batch
    assert tables.read_epochs(spark, f"{path}/final", "run_id string, n long").count() == 2


def test_runs_that_end_share_entries_of_the_state(spark, tmp_path):
    """A key of its own in the state took calls for each run, whose time grew with the runs."""
    schema, big = "run_id long, ended boolean, mask_id long, area double", 2**60 + 1  # a float has no such number
    parts = [
        [(r, False, big + 1000 * r + m, float(m)) for r in range(100) for m in range(3)] + [(None, False, 7, None)],
        [(r, False, big + 1000 * r + 3, 3.0) for r in range(0, 100, 2)] + [(r, True, None, None) for r in range(0, 100, 4)],
        [(4, False, big, 1.0), (4, True, None, None), (5, True, None, None), (5, False, big + 9, None)],
        [(r, True, None, None) for r in [*range(100), None]],
    ]
    seen, held = [], []
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = state.ended_runs(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), buckets=3)
        q = follow(spark, stream, tmp_path, lambda batch, epoch: seen.append(sorted(map(tuple, batch.collect()), key=str)))
        held += [o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]][-1:]
    gone = [[(r, big + 1000 * r + m, float(m), False) for r in range(100) for m in range(3 if r % 2 else 4) if take(r)] for take in (lambda r: r % 4 == 0, lambda r: r == 5, lambda r: r % 4 and r != 5)]
    assert seen == [sorted(x, key=str) for x in ([], gone[0], gone[1] + [(5, big + 9, None, False), (4, big, 1.0, True)], gone[2] + [(None, 7, None, False)])]
    assert held == [3, 3 + 25, 3 + 26, 101]  # a chunk a bucket, not a hundred keys; then marks of those that are over


def test_run_events_of_a_log(spark):
    rows = logs.run_events(logs.parse_log(lines(spark))).collect()
    assert sorted((r.ended, r.k, r.area) for r in rows if not r.ended) == [(False, 1, 0.5)] and [r.mask_id for r in rows if r.ended] == [None]


def test_upserts_survive_repeated_batches_and_merges(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k long, v string"
    put = tables.upsert_into(path, ["k"], gone=F.col("v") == "gone", every=2)
    batches = [[(1, "a"), (2, "b")], [(2, "c"), (3, "gone")], [(1, "d")], [(4, "e"), (2, None)], [(5, "f")]]
    table = {}
    for epoch, rows in enumerate(batches):
        table |= dict(rows)
        for _ in range(2):
            put(spark.createDataFrame(rows, schema), epoch)
        want = {k: v for k, v in table.items() if v != "gone"}
        assert {r.k: r.v for r in tables.upserted(spark, path, spark.createDataFrame([], schema).schema, ["k"]).collect()} == (want if epoch else table)
    assert len(tables._folders(spark, f"{path}/changes")) < len(batches)
    assert tables.upserted(spark, str(tmp_path / "none"), spark.createDataFrame([], schema).schema, ["k"]).count() == 0


def test_edit_state_forgets_what_was_removed(spark, tmp_path):
    schema = "image_id long, key long, seq long, op string, value string, ts timestamp"
    parts = [[(1, 5, 1, "add", "a", 10), (1, 6, 2, "add", "b", 11)], [(1, 5, 3, "remove", None, 20), (1, 6, 1, "add", "old", 12)], [(2, 1, 4, "add", "c", 5000)], [(2, 1, 5, "add", "d", 9000)]]
    put, held = tables.upsert_into(str(tmp_path / "t"), ["image_id", "key"], "seq"), []
    for rows in parts:
        df = spark.createDataFrame(rows, schema.replace("ts timestamp", "s long")).selectExpr("image_id", "key", "seq", "op", "value", "timestamp_seconds(s) as ts")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live = state.stream_edit_state(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
        q = follow(spark, live, tmp_path, put, "update")
        held += [o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]]
    rows = tables.upserted(spark, str(tmp_path / "t"), live.schema, ["image_id", "key"], "seq").collect()
    assert sorted((r.image_id, r.key, r.value, r.present) for r in rows) == [(1, 5, None, False), (1, 6, "b", True), (2, 1, "d", True)]
    assert max(held) >= 3 and held[-1] < max(held)  # 1/5 is forgotten


def test_edits_of_many_keys_share_entries_of_the_state(spark, tmp_path):
    """A key of its own in the state took calls for each key, which did not end on a larger table."""
    schema = "image_id long, key long, seq long, op string, value long, s long"
    parts = [
        [(i % 5, i, i, "add", i * 10, 10 + i) for i in range(100)],
        [(i % 5, i, 1000 + i, "remove", None, 200 + i) for i in range(0, 100, 2)] + [(None, 7, 5, "add", 1, 200), (1, 1, 0, "add", 0, 200)],
        [(9, 9, 5000, "add", 1, 90_000)], [(9, 9, 5001, "add", 2, 95_000)],
    ]
    put, held, every = tables.upsert_into(str(tmp_path / "t"), ["image_id", "key"], "seq"), [], None
    for rows in parts:
        df = spark.createDataFrame(rows, schema).selectExpr("image_id", "key", "seq", "op", "value", "timestamp_seconds(s) as ts")
        every = df if every is None else every.union(df)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live = state.stream_edit_state(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), buckets=3)
        q = follow(spark, live, tmp_path, put, "update")
        held += [o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]]
    columns = ["image_id", "key", "seq", "op", "value", "present"]
    got = {tuple(r) for r in tables.upserted(spark, str(tmp_path / "t"), live.schema, ["image_id", "key"], "seq").select(columns).collect()}
    assert got == {tuple(r) for r in state.stream_edit_state(every).select(columns).collect()} and len(got) == 102
    assert max(held) <= 12  # three buckets and their timers, not a hundred keys


def test_counts_of_a_stream_are_heard(spark, tmp_path):
    spark.range(7).write.parquet(str(tmp_path / "in"))
    heard = ObservedCounts("rows")
    spark.streams.addListener(heard)
    q = follow(spark, spark.readStream.schema("id long").parquet(str(tmp_path / "in")).observe("rows", F.count("*").alias("seen")), tmp_path)
    heard.wait(q.runId)
    spark.streams.removeListener(heard)
    assert heard.sums["seen"] == 7


def test_throughput_on_a_stream(spark, tmp_path):
    got = run(spark, lines(spark), lambda s: logs.throughput(logs.parse_log(s)), 1, tmp_path, mode="complete").collect()
    assert [(r.tiles, r.sections) for r in got] == [(2, 1)]


class _Counted(dict):
    """A map state that counts its calls."""

    calls = 0

    def _called(self, value=None):
        _Counted.calls += 1
        return value

    def exists(self):
        return self._called(bool(self))

    def containsKey(self, k):  # noqa: N802
        return self._called(k in self)

    def getValue(self, k):  # noqa: N802
        return self._called(self[k])

    def updateValue(self, k, v):  # noqa: N802
        self._called(self.update({k: v}))

    def removeKey(self, k):  # noqa: N802
        self._called(self.pop(k))

    def iterator(self):
        return self._called(list(self.items()))


def test_dedup_asks_its_state_by_squares(tmp_path):
    p = state._Dedup(None)
    p.kept, p.waiting, _Counted.calls = _Counted(), _Counted(), 0
    tile = [(n, 512.0 * (n % 16) / 16, 512.0 * (n // 16) / 16, 4.0) for n in range(256)]
    assert len(p._resolve([0], {0: tile}, {}, False)) == 256
    assert len(p._resolve([1], {1: [(1000 + m, x + 0.5, y, a) for m, x, y, a in tile]}, {}, False)) == 0  # each lies on a kept one
    assert _Counted.calls < 50 and sum(len(xs) for xs, _ in p.kept.values()) == 256


def test_runs_leave_the_state_by_chunks(monkeypatch):
    monkeypatch.setattr(state, "FRAME", 4)
    p = state._Runs(StructType.fromDDL("run_id long, mask_id long"), None)
    p.chunks, p.over = _Counted(), _Counted()
    some = lambda runs, ended=False: pd.DataFrame([(str(r), None if ended else str(n), ended) for n, r in enumerate(runs)], columns=["run_id", "mask_id", "ended"], dtype=object)
    call = lambda *frames: [tuple(r) for f in p.handleInputRows((0,), iter(frames), None) for r in f.itertuples(index=False)]
    for runs in ([1] * 6, [2] * 3, [1], [3], [2], [3] * 4):
        assert call(some(runs)) == []
    assert all(len(ids) <= 4 for ids, _ in p.chunks.values()) and len(p.chunks) == 7
    _Counted.calls = 0
    assert sorted(call(some([1], True))) == sorted([(1, n, False) for n in range(6)] + [(1, 0, False)])
    assert sorted(len(ids) for ids, _ in p.chunks.values()) == [2, 3, 4] and _Counted.calls < 20  # short chunks became one
    assert call(some([2], True), some([2, 1])) == [(1, 1, True), *[(2, n, False) for n in (0, 0, 1, 2, 0)]]
    assert len(call(some([3], True))) == 5 and not p.chunks and set(p.over) == {(1,), (2,), (3,)}


def test_offsets_of_many_files_are_short(tmp_path, monkeypatch):
    """An entry a file in JSON, and objects for each file in several forms, took the driver's memory."""
    import json

    monkeypatch.setattr(log_files, "PLAIN", 10, raising=False)
    for n in range(600):
        (tmp_path / f"run_id={n}").mkdir()
        (tmp_path / f"run_id={n}" / "run.log").write_text(f"a{n}\nb{n}\nhalf")
    read = lambda r, parts: sorted(c["path"].split("run_id=")[1].split("/")[0] + c["value"] for p in parts for b in r.read(p) for c in b.to_pylist())
    reader = log_files.GrowingReader(str(tmp_path), log_files.TASK_BYTES)
    first = reader.latestOffset()
    assert len(json.dumps(first)) < 25 * 600 and json.dumps(reader.latestOffset()) == json.dumps(first)
    parts = reader.partitions({}, json.loads(json.dumps(first)))
    assert len(parts) == 1 and len(parts[0].packed) < 40 * 600
    assert read(reader, parts) == sorted(f"{n}{x}{n}" for n in range(600) for x in "ab")
    for n in range(0, 600, 3):
        with (tmp_path / f"run_id={n}" / "run.log").open("a") as f:
            f.write(" done\n")
    (tmp_path / "run_id=1" / "run.log").write_text("anew\n")  # shorter, started anew
    (tmp_path / "run_id=2" / "run.log").write_text("other bytes, and longer than before\n")
    (tmp_path / "run_id=4" / "run.log").unlink()
    again = log_files.GrowingReader(str(tmp_path), log_files.TASK_BYTES)  # as after a start from the checkpoint
    for r in (reader, again):
        second = json.loads(json.dumps(r.latestOffset()))
        assert read(r, r.partitions(first, second)) == sorted([f"{n}half done" for n in range(0, 600, 3)] + ["1anew", "2other bytes, and longer than before"])
        assert r.partitions(second, second) == []
    # an offset that was written name by name is taken as well
    plain = {x: {"end": e, "head": h, "crc": c} for m in [log_files.Marks.of(first)] for x, e, h, c in zip(m.names(), m.end.tolist(), m.head.tolist(), m.crc.tolist(), strict=True)}
    assert len(read(again, again.partitions(plain, second))) == 202
    (tmp_path / "run_id=0" / "run.log").write_text("x\n")  # since the offset was made: the next batch reads it
    assert len(read(again, again.partitions(first, second))) == 201
