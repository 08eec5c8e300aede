"""A stream of the lines of text files that are still being written.

Spark's file source reads a file once.  This one keeps a byte offset for each file in the
stream's checkpoint, so that lines appended later arrive too: each batch reads what was
added since the last, up to the last line feed, so that half a line waits for its rest.
A file that became shorter, or that starts with other bytes than before, was started
anew and is read from its beginning.  Long additions are read by several tasks, short
ones of many files by one.  Offsets of many files are compressed, and tasks look into the
files that they read, so that the driver holds some tens of bytes a file.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "growing_text"
SCHEMA = "path string, modified timestamp, value string"
#: Bytes at a file's start that tell it from another one, and bytes of a task.
HEAD_BYTES, TASK_BYTES = 256, 16 << 20
#: Bytes that opening a file counts for when short additions are dealt to tasks, and files that the driver looks into at a time.
OPEN_BYTES, LOOKS = 16 << 10, 16
#: Files of an offset that is written name by name; one of more files is a compressed text, of some 15 bytes a file.
PLAIN = 1000
_STEP = 1 << 16


def filesystem(path: str):  # noqa: ANN201
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


class Marks:
    """How far each file was handed on: names in order, and for each the bytes, and a checksum of the first ``head`` of them.

    Arrays and one text, as there may be a million files; the driver holds a few of these.
    """

    def __init__(self, names: Iterable[str], end: np.ndarray, head: np.ndarray, crc: np.ndarray):
        self.text, self.end, self.head, self.crc = "\0".join(names).encode(), end, head, crc

    def __len__(self) -> int:
        return len(self.end)

    def names(self) -> list[str]:
        return self.text.decode().split("\0") if len(self) else []

    @classmethod
    def of(cls, offset: dict) -> Marks:
        """Of an offset as ``offset`` makes it."""
        if "" in offset:
            raw = zlib.decompress(base64.b64decode(offset[""]["packed"]))
            n = offset[""]["files"]
            end, head, crc = (np.frombuffer(raw, kind, n, at) for kind, at in (("<i8", 0), ("<i4", 8 * n), ("<u4", 12 * n)))
            out = cls((), end, head, crc)
            out.text = raw[16 * n :]
            return out
        names = sorted(offset)
        column = lambda k, kind: np.array([offset[x][k] for x in names], kind)
        return cls(names, column("end", "<i8"), column("head", "<i4"), column("crc", "<u4"))

    def offset(self) -> dict:
        if len(self) <= PLAIN:
            return {x: {"end": e, "head": h, "crc": c} for x, e, h, c in zip(self.names(), self.end.tolist(), self.head.tolist(), self.crc.tolist(), strict=True)}
        raw = b"".join([self.end.astype("<i8").tobytes(), self.head.astype("<i4").tobytes(), self.crc.astype("<u4").tobytes(), self.text])
        return {"": {"files": len(self), "packed": base64.b64encode(zlib.compress(raw)).decode()}}


def places(names: list[str], among: list[str]) -> np.ndarray:
    """The place of each of names, in order, among others, in order; -1 for those that are not there."""
    out, k = np.full(len(names), -1, "i8"), 0
    for i, name in enumerate(names):
        while k < len(among) and among[k] < name:
            k += 1
        if k < len(among) and among[k] == name:
            out[i] = k
    return out


class Pieces(InputPartition):
    """What one task reads: (file, start, end, whole, mark, before) of some files.

    Bytes [start, end) of a file; ``whole`` says that start is where a line starts.  With a mark (head, crc) the task sees whether the
    file still starts so, and reads nothing if not; with before (end, head, crc) whether it goes on where it ended, or starts anew.
    """

    def __init__(self, pieces: list[tuple]):
        self.packed = zlib.compress(json.dumps(pieces).encode())

    @property
    def pieces(self) -> list[list]:
        return json.loads(zlib.decompress(self.packed))


def dealt(pieces: Iterable[tuple], task_bytes: int) -> list[Pieces]:
    """Pieces in their order, so many to a task that their bytes and the cost of opening them stay within ``task_bytes``."""
    out, some, room = [], [], 0
    for piece in pieces:
        _, start, end, _, _, before = piece
        cost = end - (before[0] if before and before[0] <= end else start) + OPEN_BYTES
        if some and cost > room:
            out.append(Pieces(some))
            some = []
        if not some:
            room = task_bytes
        some.append(piece)
        room -= cost
    return [*out, Pieces(some)] if some else out


def _each(look: Callable, items: list) -> Iterator:
    """look(item) of all items, several at a time: what it waits for is the file system.  Only some items wait at a time."""
    with ThreadPoolExecutor(LOOKS) as pool:
        for at in range(0, len(items), 64 * LOOKS):
            yield from pool.map(look, items[at : at + 64 * LOOKS])


def _local_files(root: str, beneath: str = "") -> Iterator[tuple[str, int, int]]:
    """(name, size, time of change) of the files below a local folder, one by one; names that start with a dot or an underscore are left out."""
    try:
        found = os.scandir(f"{root}/{beneath}")
    except (FileNotFoundError, NotADirectoryError):
        return
    with found:
        for x in found:
            if x.name.startswith((".", "_")):
                continue
            try:
                if x.is_dir():
                    yield from _local_files(root, f"{beneath}{x.name}/")
                elif x.is_file():
                    info = x.stat()
                    yield f"{beneath}{x.name}", info.st_size, info.st_mtime_ns
            except FileNotFoundError:  # it went meanwhile
                continue


class GrowingText(DataSource):
    """``spark.readStream.format(FORMAT).load(folder)`` once the class is registered: rows of path, modified, value."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingReader:  # noqa: ANN001, N802
        return GrowingReader(self.options["path"], int(self.options.get("taskBytes", TASK_BYTES)))


class GrowingReader(DataSourceStreamReader):
    """Offsets are those of ``Marks``: for each file below the folder the bytes that were handed on, and a checksum of the first of them."""

    def __init__(self, folder: str, task_bytes: int):
        self.folder, self.task_bytes = folder, task_bytes
        self.seen: tuple[Marks, np.ndarray] | None = None  # with (size, time of change) of each file, so that what did not change is not opened

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def _files(self) -> tuple:
        """The file system, the folder in it, the names of its files in order, and size and time of change of each."""
        from pyarrow import fs

        system, root = filesystem(self.folder)
        if isinstance(system, fs.LocalFileSystem):
            found = _local_files(root)
        else:
            infos = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
            names = ((x.path.removeprefix(root).lstrip("/"), x) for x in infos if x.is_file)
            found = ((name, x.size, x.mtime_ns or 0) for name, x in names if not any(part.startswith((".", "_")) for part in name.split("/")))
        names, told = [], []
        for name, size, changed in found:
            names.append(name)
            told += (size, changed)
        told = np.array(told, "i8").reshape(-1, 2)
        order = sorted(range(len(names)), key=names.__getitem__)
        return system, root, [names[i] for i in order], told[order]

    def latestOffset(self) -> dict:  # noqa: N802
        system, root, names, told = self._files()
        end, head, crc = np.zeros(len(names), "<i8"), np.zeros(len(names), "<i4"), np.zeros(len(names), "<u4")
        new = np.ones(len(names), bool)
        if self.seen:
            old, before = self.seen
            at = places(names, old.names())
            same = np.flatnonzero(at >= 0)
            same = same[(before[at[same]] == told[same]).all(axis=1)]
            new[same] = False
            end[same], head[same], crc[same] = old.end[at[same]], old.head[at[same]], old.crc[at[same]]

        def look(i: int) -> tuple[int, int, int]:
            try:
                with system.open_input_file(f"{root}/{names[i]}") as f:
                    upto = last_line_end(f, int(told[i, 0]))
                    first = min(upto, HEAD_BYTES)
                    return upto, first, zlib.crc32(f.read_at(first, 0)) if first else 0
            except FileNotFoundError:  # it went meanwhile
                return 0, 0, 0

        looks = np.flatnonzero(new).tolist()
        for i, mark in zip(looks, _each(look, looks), strict=True):
            end[i], head[i], crc[i] = mark
        self.seen = Marks(names, end, head, crc), told
        some = np.flatnonzero(end)
        return Marks((names[i] for i in some), end[some], head[some], crc[some]).offset()

    def partitions(self, start: dict, end: dict) -> list[Pieces]:
        was, upto = Marks.of(start), Marks.of(end)
        names = upto.names()
        at = places(names, was.names())
        return dealt(self._pieces(names, was, upto, at), self.task_bytes)

    def _pieces(self, names: list[str], was: Marks, upto: Marks, at: np.ndarray) -> Iterator[tuple]:
        marks = lambda m, i: (int(m.end[i]), int(m.head[i]), int(m.crc[i]))
        for i, name in enumerate(names):
            now, before = marks(upto, i), marks(was, at[i]) if at[i] >= 0 else None
            if now == before:
                continue
            if now[0] <= self.task_bytes:
                yield name, 0, now[0], True, now[1:], before
                continue
            # of long files the parts of what was added are dealt, so it is told here where that starts
            if (first := self._start(name, now[1:], before, now[0])) is not None:
                for a in range(first, now[0], self.task_bytes):
                    yield name, a, min(a + self.task_bytes, now[0]), a == first, None, None

    def _start(self, name: str, mark: tuple | list, before: tuple | list | None, end: int) -> int | None:
        """Where what was added to a file starts; None if it is gone, or was started anew since this offset was made: the next batch reads it."""
        system, root = filesystem(self.folder)
        try:
            with system.open_input_file(f"{root}/{name}") as f:
                if zlib.crc32(f.read_at(mark[0], 0)) != mark[1]:
                    return None
                return before[0] if before and before[0] <= end and zlib.crc32(f.read_at(before[1], 0)) == before[2] else 0
        except FileNotFoundError:
            return None

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        """Lines that start in the pieces; the last one of a piece may end behind it."""
        kinds = pa.schema([("path", pa.string()), ("modified", pa.timestamp("us", "UTC")), ("value", pa.string())])
        held: list[tuple[str, datetime, list[str]]] = []
        system, root = filesystem(self.folder)
        n = 0
        for name, start, end, whole, mark, before in partition.pieces:
            first = self._start(name, mark, before, end) if mark else start
            info = system.get_file_info(f"{root}/{name}")
            if first is None or not info.is_file:
                continue
            time = datetime.fromtimestamp((info.mtime_ns or 0) // 1000 / 1e6, timezone.utc)
            for lines in self._lines(info.path, first, end, whole):
                held.append((info.path, time, lines))
                n += len(lines)
                if n >= 10_000:
                    yield self._batch(held, kinds)
                    held, n = [], 0
        if n:
            yield self._batch(held, kinds)

    @staticmethod
    def _batch(held: list[tuple[str, datetime, list[str]]], kinds: pa.Schema) -> pa.RecordBatch:
        many = lambda k: [h[k] for h in held for _ in h[2]]
        return pa.RecordBatch.from_arrays([pa.array(many(0)), pa.array(many(1), kinds.field(1).type), pa.array([x for h in held for x in h[2]], pa.string())], schema=kinds)

    def _lines(self, path: str, start: int, end: int, whole: bool) -> Iterator[list[str]]:
        system, _ = filesystem(self.folder)
        with system.open_input_file(path) as f:
            at, rest, lines = start, b"", []
            if not whole:  # the line that reaches into the piece is its predecessor's
                at = next_line(f, start - 1)
            while at < end or rest:
                block = f.read_at(_STEP, at + len(rest))
                *full, rest = (rest + block).split(b"\n")
                for line in full:
                    if at >= end:
                        rest = b""
                        break
                    lines.append(line.decode("utf-8", "replace"))
                    at += len(line) + 1
                if not block or at >= end:
                    rest = b""
                    if not block:
                        at = end
                if len(lines) >= 10_000 or (lines and at >= end):
                    yield lines
                    lines = []

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


def last_line_end(f, size: int) -> int:  # noqa: ANN001
    """The place after the last line feed within ``size`` bytes (0 if there is none)."""
    stop = size
    while stop > 0:
        start = max(0, stop - _STEP)
        at = f.read_at(stop - start, start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        stop = start
    return 0


def next_line(f, place: int) -> int:  # noqa: ANN001
    """The place after the first line feed at or behind ``place``."""
    while block := f.read_at(_STEP, place):
        at = block.find(b"\n")
        if at >= 0:
            return place + at + 1
        place += len(block)
    return place


def growing_lines(spark: SparkSession, folder: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """A stream of path, modified and value: each line of each file below ``folder`` once, as soon as its line feed is written.

    Files may grow, appear, be removed or be started anew; a stream that is started again goes on where its checkpoint
    stands.  Lines that a file loses before a batch has read them are lost.  Names that start with a dot or an
    underscore are left out.  An empty line is an empty value; bytes that are no UTF-8 become U+FFFD.  The checkpoint
    holds an entry for each file that is there, so files of runs long over should be moved away.  The folder must be
    one that the driver and the executors reach: a shared path, or a URI that Arrow's file systems open.
    """
    spark.dataSource.register(GrowingText)
    return spark.readStream.format(FORMAT).option("taskBytes", task_bytes).load(folder)
