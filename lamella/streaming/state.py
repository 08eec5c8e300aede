"""Streams with keyed state: de-duplication, the live state of edits, and runs that end.

State lies in RocksDB, by key of the state and not by run: a batch reads and writes the
entries that its rows touch, whatever else a run, or runs that are over, have left.
"""

from __future__ import annotations

import contextlib
import itertools
import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, IntegralType, LongType, StructField, StructType

from ..functions.lineage import cut
from ..operators.spatial import conflict_edges, resolve

KEPT = "run_id string, mask_id long, k long, x double, y double, area double"
#: Side of the square cells by which kept centres are stored, and of those by which they are looked up: each access to
#: the state is a call out of Python, so an entry of the state holds a square of 4 by 4 of the latter.
STORED, CELL = 256.0, 64.0
#: Entries of the state among which the keys of edits, and runs that end, are dealt.
BUCKETS = 8192
#: Rows of a frame that a processor hands on, and of a chunk in the state.
FRAME = 10_000


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which state by key needs."""
    name, kind = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, kind)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


class _Dedup(StatefulProcessor):
    """State of a run: its turn (next tile, last tile), kept centres by cell, tiles that wait by number."""

    def __init__(self, silence_ms: int | None):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turn = handle.getValueState("turn", "next long, last long")
        self.kept = handle.getMapState("kept", "cx long, cy long", "x array<double>, y array<double>")
        self.waiting = handle.getMapState("waiting", "k long", "mask_id array<long>, x array<double>, y array<double>, area array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        before = self.turn.get()
        upto, last = before or (0, -1)
        came: dict[int, list] = {}
        failed = False
        for frame in rows:
            for k, mask, x, y, area, ends in zip(*(frame[c].tolist() for c in ("k", "mask_id", "x", "y", "area", "last")), strict=True):
                if k is None or k != k:
                    failed = failed or bool(ends)
                    continue
                tile = came.setdefault(int(k), [])
                if mask is not None and mask == mask:
                    tile.append((int(mask), float(x), float(y), float(area)))
                if ends:
                    last = max(last, int(k))
        waiting = self._waiting() if before else {}
        ready = []
        while upto in came or upto in waiting:
            ready.append(upto)
            upto += 1
        over = failed or 0 <= last < upto
        if over:
            ready += sorted((waiting.keys() | came.keys()) - set(ready))
        out = self._resolve(ready, came, waiting, over)
        if over:
            self._forget()
        else:
            for k in sorted(set(came) - set(ready)):
                self.waiting.updateValue((k,), tuple(list(c) for c in zip(*(waiting.get(k, []) + came[k]), strict=True)) or ([], [], [], []))
            self.turn.update((upto, last))
            if self.silence_ms:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silence_ms)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        waiting = self._waiting()
        out = self._resolve(sorted(waiting), {}, waiting, True)
        self._forget()
        yield self._frame(key, out)

    def close(self) -> None:
        pass

    def _waiting(self) -> dict[int, list]:
        """The rows of all tiles that wait, read at once."""
        return {int(k): list(zip(*value, strict=True)) for (k,), value in self.waiting.iterator()}

    def _forget(self) -> None:
        self.turn.clear()
        self.kept.clear()
        self.waiting.clear()
        if self.silence_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)

    def _resolve(self, ready: list[int], came: dict[int, list], waiting: dict[int, list], over: bool) -> list[tuple]:
        """What is kept of these tiles, in their order; the squares that change are written once."""
        cells: dict[tuple[int, int], tuple[list, list]] = {}
        squares: set[tuple[int, int]] = set()
        per, changed, everything, out = int(STORED / CELL), set(), False, []

        def put(xs, ys) -> None:  # noqa: ANN001
            for x, y in zip(xs, ys, strict=True):
                mine = cells.setdefault((math.floor(x / CELL), math.floor(y / CELL)), ([], []))
                mine[0].append(x)
                mine[1].append(y)

        def cell(at: tuple[int, int]) -> tuple[list, list]:
            square = (at[0] // per, at[1] // per)
            if not everything and square not in squares:
                squares.add(square)
                if self.kept.containsKey(square):
                    put(*self.kept.getValue(square))
            return cells.get(at, ((), ()))

        for k in ready:
            tile = waiting.get(k, []) + came.get(k, [])
            for mask, x, y, area in sorted(tile, key=lambda r: (-r[3], r[0])):
                reach = 0.5 * math.sqrt(max(area, 1.0))
                cx, cy = (range(math.floor((v - reach) / CELL), math.floor((v + reach) / CELL) + 1) for v in (x, y))
                if len(cx) * len(cy) > 256 and not everything:  # a wide reach: all squares of the run are read once
                    for square, (xs, ys) in self.kept.iterator():
                        if tuple(square) not in squares:
                            put(xs, ys)
                    everything = True
                near = cells.values() if everything and len(cx) * len(cy) > len(cells) else (cell((a, b)) for a in cx for b in cy)
                if any(abs(x - p) < reach and abs(y - q) < reach for xs, ys in near for p, q in zip(xs, ys, strict=True)):
                    continue
                at = (math.floor(x / CELL), math.floor(y / CELL))
                cell(at)
                put([x], [y])
                changed.add((at[0] // per, at[1] // per))
                out.append((mask, k, x, y, area))
            if k in waiting and not over:
                self.waiting.removeKey((k,))
        if not over:
            for a, b in changed:
                mine = [cells[i, j] for i in range(a * per, (a + 1) * per) for j in range(b * per, (b + 1) * per) if (i, j) in cells]
                self.kept.updateValue((a, b), ([x for xs, _ in mine for x in xs], [y for _, ys in mine for y in ys]))
        return out

    @staticmethod
    def _frame(key: tuple, out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["mask_id", "k", "x", "y", "area"])
        frame.insert(0, "run_id", str(key[0]))
        return frame.astype({"mask_id": "int64", "k": "int64", "x": "float64", "y": "float64", "area": "float64"})


def stream_dedup(sections: DataFrame, silence_ms: int | None = None) -> DataFrame:
    """Greedy de-duplication per run as tiles arrive.  sections(run_id, k, mask_id, x, y, area, last): ``last`` marks a row of the
    run's last tile, or with a null k that the run failed; a row with a null mask_id tells that its tile is empty.

    A tile is resolved once all smaller k (from 0) are there, so tiles may come in any order; the rows of a tile
    come in one batch.  A run is over after its last tile.  When it fails, or nothing comes for ``silence_ms`` where that is given, what
    is waiting is resolved in order, and the state of the run goes; so partial results are kept.  A stream with a silence
    never runs out of batches, so it is for streams that follow a source, not for those that stop when it is read.
    What a batch writes of the state are the cells of centres that it kept, the tiles that it left waiting, and the run's turn.
    Start such a stream inside ``keyed_state``.  On a table the same rule is resolved by binned joins.
    """
    if not sections.isStreaming:
        rank = F.struct("k", (-F.col("area")).alias("a"), "mask_id")
        points = cut(sections.where("mask_id is not null").select(F.struct("run_id", "mask_id").alias("id"), F.col("run_id").alias("image_id"), rank.alias("rank"), "x", "y", (0.5 * F.sqrt(F.greatest("area", F.lit(1.0)))).alias("r"), "k", "area"))
        kept = points.join(resolve(points, conflict_edges(points)), "id", "left_semi")
        return kept.select(F.col("image_id").alias("run_id"), "id.mask_id", "k", "x", "y", "area")
    rows = sections.select("run_id", "k", "mask_id", "x", "y", "area", "last")
    return rows.groupBy("run_id").transformWithStateInPandas(_Dedup(silence_ms), KEPT, "Append", "ProcessingTime" if silence_ms else "None")


class _Edits(StatefulProcessor):
    """State of a bucket of keys: the last edit of each, and when it is forgotten (-1: it is not); one timer for the first of these."""

    def __init__(self, fields: StructType, forget_ms: int):
        self.fields, self.forget_ms = fields, forget_ms
        self.whole = [isinstance(f.dataType, IntegralType) for f in fields]  # numbers that pandas turns into floats where some are null

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", ", ".join(f"`{f.name}` array<{f.dataType.simpleString()}>" for f in self.fields) + ", until array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        known, changed = self._known(), {}
        was = self._due(known)
        for frame in rows:
            columns = [[None if v is None or v != v else int(v) if whole else v for v in frame[f.name].tolist()] for f, whole in zip(self.fields, self.whole, strict=True)]
            for image, name, seq, op, value, ms in zip(*columns, frame["ms"].tolist(), strict=True):
                at = (image, name)
                if seq is not None and (at not in known or seq > known[at][0]):
                    known[at] = changed[at] = (seq, op, value, int(ms) + self.forget_ms if op == "remove" else -1)
        if changed:
            self._keep(known, was)
            yield pd.DataFrame([(*at, *e[:3], e[1] != "remove") for at, e in changed.items()], columns=[*self.fields.names, "present"], dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        self._keep({at: e for at, e in self._known().items() if not 0 <= e[3] <= passed}, None)  # its own timer is over
        return iter(())

    def close(self) -> None:
        pass

    def _known(self) -> dict[tuple, tuple]:
        held = self.last.get()
        return {(r[0], r[1]): r[2:] for r in zip(*held, strict=True)} if held else {}

    @staticmethod
    def _due(known: dict[tuple, tuple]) -> int | None:
        return min((e[3] for e in known.values() if e[3] >= 0), default=None)

    def _keep(self, known: dict[tuple, tuple], was: int | None) -> None:
        due = self._due(known)
        if due != was:
            if was is not None:
                self.handle.deleteTimer(was)
            if due is not None:
                self.handle.registerTimer(due)
        if known:
            self.last.update(tuple(list(c) for c in zip(*((*at, *e) for at, e in known.items()), strict=True)))
        else:
            self.last.clear()


def stream_edit_state(edits: DataFrame, lateness: str = "10 minutes", forget_ms: int = 600_000, buckets: int = BUCKETS) -> DataFrame:
    """Live state of edits(image_id, key, seq, op, value): image_id, key, seq, op, value and present of the last event per key.

    On a stream, where edits have a ``ts`` too, a row comes whenever a key changes (update mode; ``upsert_into`` keeps the
    table).  What is removed stays known until the watermark is ``forget_ms`` past the removal, and then its state goes; edits
    that are older than ``lateness`` are dropped.  Keys share an entry of the state by their hash, as each call of a processor
    takes some milliseconds whatever it is given: a batch calls once for each of the ``buckets`` that its rows touch, and reads
    and writes these.  Their number stays as long as the checkpoint.  Start the stream inside ``keyed_state``.
    """
    if not edits.isStreaming:
        last = edits.groupBy("image_id", "key").agg(F.max_by(F.struct("seq", "op", "value"), "seq").alias("e"))
        return last.select("image_id", "key", "e.seq", "e.op", "e.value", (F.col("e.op") != "remove").alias("present"))
    fields = StructType([StructField("seq", LongType()) if c == "seq" else edits.schema[c] for c in ("image_id", "key", "seq", "op", "value")])
    out = StructType([*fields, StructField("present", BooleanType())])
    rows = edits.select(*fields.names, "ts", F.unix_millis("ts").alias("ms"), F.pmod(F.xxhash64("image_id", "key"), F.lit(buckets)).alias("bucket"))
    return rows.withWatermark("ts", lateness).groupBy("bucket").transformWithStateInPandas(_Edits(fields, forget_ms), out, "Update", "EventTime")


class _Runs(StatefulProcessor):
    """State of a bucket of runs: the rows that wait for the end of theirs, in chunks, and afterwards, for a time, which runs are over."""

    def __init__(self, columns: StructType, remember_ms: int | None):
        self.columns, self.remember_ms = columns, remember_ms  # the run's id first
        self.whole = [isinstance(f.dataType, IntegralType) for f in columns]  # these come as text

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chunks = handle.getMapState("chunks", "name string", ", ".join(f"`{f.name}` array<{f.dataType.simpleString()}>" for f in self.columns))
        self.over = handle.getMapState("over", StructType([self.columns[0]]), "over boolean", self.remember_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        some_over, late, ends, came = self.over.exists(), {}, set(), []
        for frame in rows:
            columns = [[None if v is None or v != v else int(v) if whole else v for v in frame[n].tolist()] for n, whole in zip(self.columns.names, self.whole, strict=True)]
            for run in set(columns[0]) - late.keys():
                late[run] = some_over and self.over.containsKey((run,))
            after = []
            for row, ended in zip(zip(*columns, strict=True), frame["ended"].tolist(), strict=True):
                if not ended:
                    (after if late[row[0]] else came).append(row)
                elif not late[row[0]]:
                    ends.add(row[0])
            yield from self._frames(after, True)
            came = self._put(came, FRAME)
        if ends:
            yield from self._frames(self._take(ends, came), False)
            for run in ends:
                self.over.updateValue((run,), (True,))
        else:
            self._put(came, 1)

    def _put(self, rows: list[tuple], least: int) -> list[tuple]:
        """Writes rows as chunks, and returns those that are left, fewer than ``least``."""
        while len(rows) >= least:
            self.chunks.updateValue((uuid.uuid4().hex,), tuple(list(c) for c in zip(*rows[:FRAME], strict=True)))
            rows = rows[FRAME:]
        return rows

    def _take(self, ends: set, came: list[tuple]) -> Iterator[tuple]:
        """The rows of these runs, which leave the state; a chunk is in memory at a time, and short ones that are left become one."""
        yield from (r for r in came if r[0] in ends)
        rest = [r for r in came if r[0] not in ends]
        for name in list(self.chunks.keys()):
            chunk = list(zip(*self.chunks.getValue(name), strict=True))
            stay = [r for r in chunk if r[0] not in ends]
            if len(stay) == len(chunk) >= FRAME // 2:
                continue
            self.chunks.removeKey(name)
            yield from (r for r in chunk if r[0] in ends)
            rest = self._put(rest + stay, FRAME)
        self._put(rest, 1)

    def _frames(self, rows, late: bool) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        rows = iter(rows)
        while some := list(itertools.islice(rows, FRAME)):
            yield pd.DataFrame([(*r, late) for r in some], columns=[*self.columns.names, "late"], dtype=object)

    def close(self) -> None:
        pass


def ended_runs(rows: DataFrame, remember_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """All rows of each run once it is over, and rows that come later with ``late``.

    rows(run_id, ended, ...) is a stream; a row with ``ended`` tells that its run is done or failed, the others wait in the state
    until then.  Runs share an entry of the state by their hash, as edits do: a batch calls once for each of the ``buckets`` that
    its rows touch and adds a chunk of rows to it; when runs end, the chunks of their bucket are read one by one.  Their number stays as
    long as the checkpoint.  What a run left in the state goes when it ends, but for the mark that it is over.  With ``remember_ms`` that
    goes too after this time (rows later than that would wait for an end that never comes); such a stream never runs out of batches, so
    it is for those that follow a source.  Start the stream inside ``keyed_state``.
    """
    columns = StructType([rows.schema["run_id"], *[f for f in rows.schema.fields if f.name not in ("run_id", "ended")]])
    out = StructType([*columns, StructField("late", BooleanType())])
    # pandas would turn whole numbers into floats where some are null
    exact = [F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, IntegralType) else F.col(f.name) for f in columns]
    dealt = rows.select(*exact, "ended", F.pmod(F.xxhash64("run_id"), F.lit(buckets)).alias("bucket"))
    return dealt.groupBy("bucket").transformWithStateInPandas(_Runs(columns, remember_ms), out, "Append", "ProcessingTime" if remember_ms else "None")
