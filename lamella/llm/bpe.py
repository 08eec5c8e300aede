"""Byte-pair encoding of whole texts with the ids of the ``tokenizers`` library, and decoding.

A text of at most ``segment`` characters is encoded in the task that reads it.  A longer
one is a tree: it is cut into segments, which Spark deals over tasks of their own.

* Where a segment's second half has a place at which the tokenizer always ends a
  pre-token, the cut is there, and the ids on both sides are final.
* Long text without such a place (a run of letters, of digits, of signs or of white
  space) is cut within the pre-token.  Such joins are mended by tree concatenation, in
  rounds of Spark that join neighbours, then neighbours of neighbours: the last ids of
  the left side and the first ids of the right one are encoded again as one text, in
  windows that grow until their first id is the left side's and their last id is the
  right side's (or the window reaches the pre-token's end).

Why that is exact: merges are applied in the order of their rank, so a sequence of ids
is the encoding of its text exactly if every two neighbours are the encoding of theirs.
Inside a side neighbours are right already, inside the window the library has made them,
and at the window's edges the agreeing ids have the neighbours that they had before.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from . import textbits as tb
from .shared import tasks, written
from .tokens import encoder

#: Characters of a text that are encoded at once.
SEGMENT = 1 << 19
#: Ids on each side of a join that are encoded again at first.
WINDOW = 8


@functools.cache
def _safe():  # noqa: ANN202
    import regex

    other = r"\p{White_Space}\p{L}\p{N}"
    return regex.compile(rf"(?<=\p{{L}})(?=\P{{L}})|(?<=\p{{N}})(?=\P{{N}})|(?<=[^{other}])(?=[\p{{White_Space}}\p{{N}}])|(?<=[^{other}'])(?=\p{{L}})")


def segments(text: str, tokenizer, size: int) -> list[tuple[int, bool]]:  # noqa: ANN001
    """Where the segments of a text start, and whether the cut there lies within a pre-token.

    Special tokens are never cut.  ``size`` must be at least 64 characters."""
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    parts = lambda a, z: len(tokenizer.pre_tokenizer.pre_tokenize_str(text[a:z]))

    def in_added(p: int) -> bool:
        return any(0 <= (at := text.find(t, max(0, p - len(t) + 1), p + len(t) - 1)) < p for t in added)

    out, start = [(0, False)], 0
    while len(text) - start > size:
        low, high = start + size // 2, start + size
        places = {low + m.start() for m in _safe().finditer(text[low:high])} - {low, high}
        for t in added:  # the ends of special tokens
            at = text.find(t, low, high)
            while at >= 0:
                places.add(at + len(t))
                at = text.find(t, at + 1, high)
        sure = next((p for p in sorted(places, reverse=True) if p < high and not in_added(p) and (parts(p - 1, p + 1) == 2 or text[:p].endswith(tuple(added)))), None)
        if sure is not None:
            start = sure
            out.append((start, False))
            continue
        inner = [start + size * k // 16 for k in (12, 11, 13, 10)] + list(range(low + 2, high - 2))
        start = next(p for p in inner if not in_added(p) and parts(p - 2, p + 2) == 1)
        out.append((start, True))
    return out


class Words:
    """Bytes and decimal names of a byte-level vocabulary's ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in set(shown))}
        names = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        raw = [bytes(byte_of[c] for c in names.get(i, "")) for i in range(max(names) + 1)]
        self.length = np.array([len(x) for x in raw], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        self.decimal = [str(i) for i in range(len(raw))]
        self.inside = np.array([bool(x) and 0x80 <= x[0] < 0xC0 for x in raw])  # starts within a character

    def text(self, ids: np.ndarray) -> bytes:
        return self.flat[tb.ranges(self.start[ids], self.length[ids])].tobytes()

    def names(self, ids: np.ndarray) -> str:
        return ",".join(map(self.decimal.__getitem__, ids.tolist()))


@functools.cache
def words(path: str) -> Words:
    """The worker's own tables of this vocabulary file."""
    return Words(path)


def join(left: np.ndarray, tail: int, right: np.ndarray, head: int, path: str, window: int = WINDOW) -> tuple[np.ndarray, int, int]:
    """The ids of two neighbours' text, and how many of them stand before the last ``tail`` ids of the left
    and after the first ``head`` ids of the right one; those ids are of one pre-token."""
    bits, enc = words(path), encoder(path).tokenizer
    a, z = min(window, tail), min(window, head)
    while True:
        while a < tail and bits.inside[left[len(left) - a]]:
            a += 1
        while z < head and bits.inside[right[z]]:
            z += 1
        text = (bits.text(left[len(left) - a :]) + bits.text(right[:z])).decode()
        new = np.array(enc.encode(text, add_special_tokens=False).ids, np.uint32)
        agrees_left, agrees_right = a == tail or new[0] == left[len(left) - a], z == head or new[-1] == right[z - 1]
        if agrees_left and agrees_right:
            return np.concatenate([left[: len(left) - a], new, right[z:]]), len(left) - tail, len(right) - head
        a, z = a if agrees_left else min(2 * a, tail), z if agrees_right else min(2 * z, head)


def _encode_batch(path: str, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return encoder(path).encode(*tb.text_buffer(column))


def _binary(ids: np.ndarray, first: np.ndarray) -> pa.Array:
    offsets = pa.array(first * 4, pa.int64())
    return pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(ids, "<u4"))]).cast(pa.binary())


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def _long(plain: DataFrame, vocabulary: str, segment: int) -> DataFrame:
    """(id, row, part, ids) of the texts of over ``segment`` characters; the parts of a row in their order make up its ids."""
    spark, kind = plain.sparkSession, plain.schema["id"]
    dealt = StructType([kind, StructField("row", StringType()), StructField("part", IntegerType()), StructField("open", BooleanType()), StructField("closes", BooleanType()), StructField("text", StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n, tok = TaskContext.get().partitionId(), 0, encoder(vocabulary).tokenizer
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column("text")[k].as_py()
                at, n = segments(text, tok, segment), n + 1
                ends = [x for x, _ in at[1:]] + [len(text)]
                for p in range(0, len(at), 16):  # a few segments at once
                    m = min(16, len(at) - p)
                    opened = [at[p + j][1] for j in range(m)]
                    closes = [p + j + 1 < len(at) and at[p + j + 1][1] for j in range(m)]
                    cols = [pc.take(batch.column("id"), pa.array([k] * m)), pa.array([f"{task}-{n}"] * m), pa.array(range(p, p + m), pa.int32()), pa.array(opened), pa.array(closes), pa.array([text[at[p + j][0] : ends[p + j]] for j in range(m)])]
                    yield pa.RecordBatch.from_arrays(cols, names=dealt.names)

    # rows are named by task and number, so the table of segments is written before it is used
    pieces = plain.where(F.length("text") > segment).mapInArrow(cut, dealt)
    pieces = written(pieces.repartition(tasks(spark), "row", "part"), "bpe-segments")
    coded = StructType([kind, *[StructField(c, t) for c, t in (("row", StringType()), ("part", IntegerType()), ("open", BooleanType()), ("ids", BinaryType()), ("head", LongType()), ("tail", LongType()))]])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(vocabulary).tokenizer
        added = tuple(t.content for t in tok.get_added_tokens_decoder().values())
        count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
        for batch in tb.slices(batches):
            ids, first = _encode_batch(vocabulary, batch.column("text"))
            head, tail = [0] * batch.num_rows, [0] * batch.num_rows
            for k in range(batch.num_rows):
                if not (batch.column("open")[k].as_py() or batch.column("closes")[k].as_py()):
                    continue
                text = batch.column("text")[k].as_py()
                begins = text[: min((i for t in added if (i := text.find(t)) >= 0), default=len(text))]
                ends = text[max((i + len(t) for t in added if (i := text.rfind(t)) >= 0), default=0) :]
                spans = tok.pre_tokenizer.pre_tokenize_str(begins)
                head[k] = count(begins[: spans[0][1][1]]) if spans else 0
                spans = tok.pre_tokenizer.pre_tokenize_str(ends)
                tail[k] = count(ends[spans[-1][1][0] :]) if spans else 0
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), batch.column("part"), batch.column("open"), _binary(ids, first), pa.array(head, pa.int64()), pa.array(tail, pa.int64())], names=coded.names)

    nodes = written(pieces.mapInArrow(leaves, coded), "bpe-leaves")

    def joined(key: tuple, table: pa.Table) -> pa.Table:
        """A node of the next level from its one or two children."""
        table = table.sort_by("part")
        row = table.slice(0, 1).to_pylist()[0]
        if table.num_rows == 2 and table.column("open")[1].as_py():
            other = table.slice(1, 1).to_pylist()[0]
            left, right = (np.frombuffer(x["ids"], "<u4") for x in (row, other))
            ids, before, after = join(left, row["tail"], right, other["head"], vocabulary)
            row |= {"ids": ids.tobytes(), "head": row["head"] if row["head"] < len(left) else len(ids) - after, "tail": other["tail"] if other["tail"] < len(right) else len(ids) - before}
        elif table.num_rows == 2:
            raise AssertionError("two nodes of one place that are not joined")
        fields = [table.schema.field(c) for c in coded.names]
        return pa.Table.from_pylist([{c: row[c] for c in coded.names}], schema=pa.schema(fields))

    # runs of segments that are joined by open cuts: the run's first segment names it
    from pyspark.sql import Window

    along = Window.partitionBy("row").orderBy("part")
    light = nodes.select("row", "part", "open").withColumn("run", F.max(F.when(~F.col("open"), F.col("part"))).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    runs = written(light.groupBy("row", "run").agg(F.count("*").alias("n")).where("n > 1").select("row", "run", "n"), "bpe-runs")
    longest = runs.agg(F.max("n")).first()[0]
    if not longest:
        return nodes.select("id", "row", "part", "ids")
    member = light.join(runs, ["row", "run"]).select("row", "part", "run")
    alone = nodes.join(member, ["row", "part"], "left_anti").select("id", "row", "part", "ids")
    trees = nodes.join(member, ["row", "part"])
    part = trees.withColumn("part", F.col("part") - F.col("run"))
    while longest > 1:
        halves = part.withColumn("place", F.floor(F.col("part") / 2).cast("int"))
        with_run = StructType([*coded.fields, StructField("run", IntegerType())])

        def level(key: tuple, table: pa.Table) -> pa.Table:
            run = table.column("run").slice(0, 1)
            return joined(key, table.drop_columns(["run", "place"])).append_column(pa.field("run", pa.int32()), run)

        part = written(halves.groupBy("row", "run", "place").applyInArrow(level, with_run).withColumn("part", F.floor(F.col("part") / 2).cast("int")), "bpe-level")
        longest = -(-longest // 2)
    return alone.union(part.select("id", "row", (F.col("part") + F.col("run")).alias("part"), "ids"))


def bpe_encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """The ids of every whole text as rows ``id_col, row, part, ids``: ids is an array of int, the parts of a row in their order
    make up a text's ids, and ``row`` is null for the texts of at most ``segment`` characters, which have one part.

    Cases: null and empty texts have one part without ids.  Repeated rows and null ids are rows of their own.  An
    empty table gives an empty result.  A very long text is many parts, so that no task holds all its ids; a run of one
    class of characters that is longer than a segment (a pre-token) is one part.  Other columns of docs are ignored.
    """
    plain = _plain(docs, id_col, text_col)
    kind = plain.schema["id"]
    out = StructType([kind, StructField("ids", BinaryType())])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("id"), _binary(*_encode_batch(vocabulary, batch.column("text")))], names=out.names)

    direct = plain.where(F.length("text") <= segment).mapInArrow(short, out).select("id", F.lit(None).cast("string").alias("row"), F.lit(0).alias("part"), "ids")
    both = direct.union(_long(plain, vocabulary, segment))
    listed = StructType([kind, StructField("row", StringType()), StructField("part", IntegerType())])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = tb.text_buffer(batch.column("ids"))
            ids = pa.array(np.ascontiguousarray(raw).view("<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in listed.names], pa.ListArray.from_arrays(pa.array((offs // 4).astype(np.int32)), ids)], names=[*listed.names, "ids"])

    return both.mapInArrow(unpack, StructType([*listed.fields, StructField("ids", ArrayType(IntegerType()))])).withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``text`` in place of the ids of ``bpe_encode``'s rows (any rows with a column ``ids``, an array of int).

    Bytes that are no UTF-8 become U+FFFD, as in the library; ids that are not in the vocabulary give nothing."""
    kept = StructType([f for f in encoded.schema.fields if f.name != "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = words(vocabulary)
        for batch in batches:
            texts = []
            for ids in batch.column("ids"):
                ids = np.asarray(ids.values if ids.is_valid else [], np.int64)
                texts.append(bits.text(ids[(ids >= 0) & (ids < len(bits.length))]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept.names], pa.array(texts, pa.string())], names=[*kept.names, "text"])

    return encoded.mapInArrow(run, StructType([*kept.fields, StructField("text", StringType())]))


def bpe_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """One row per text: ``id_col, n_tokens, ids_sha256, decoded_sha256`` of the ids of ``bpe_encode`` and what they decode to.

    The parts of a long text are read one after another, sorted, so that no task holds a whole text's ids.
    Cases: as ``bpe_encode``; a null or empty text has no ids and the digests of nothing.
    """
    plain = _plain(docs, id_col, text_col)
    kind = plain.schema["id"]
    out = StructType([kind, StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = words(vocabulary)
        for batch in tb.slices(batches):
            ids, first = _encode_batch(vocabulary, batch.column("text"))
            told, back = [], []
            raw = bits.text(ids)
            at = np.concatenate([[0], np.cumsum(bits.length[ids])])[first].tolist()
            edge = first.tolist()
            for k in range(batch.num_rows):
                told.append(hashlib.sha256(bits.names(ids[edge[k] : edge[k + 1]]).encode()).hexdigest())
                back.append(hashlib.sha256(raw[at[k] : at[k + 1]].decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(first)), pa.array(told), pa.array(back)], names=out.names)

    def rolling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, row, state = words(vocabulary), None, None

        def told() -> pa.RecordBatch:
            state["text"].update(state["utf8"].decode(b"", True).encode())
            return pa.RecordBatch.from_arrays([state["id"], pa.array([state["n"]], pa.int64()), pa.array([state["ids"].hexdigest()]), pa.array([state["text"].hexdigest()])], names=out.names)

        for batch in batches:
            for k in range(batch.num_rows):
                name = batch.column("row")[k].as_py()
                if name != row:
                    if state:
                        yield told()
                    row, state = name, {"id": pc.take(batch.column("id"), pa.array([k])), "n": 0, "ids": hashlib.sha256(), "text": hashlib.sha256(), "utf8": codecs.getincrementaldecoder("utf-8")("replace")}
                ids = np.frombuffer(batch.column("ids")[k].as_py(), "<u4")
                if len(ids):
                    state["ids"].update(("," if state["n"] else "").encode() + bits.names(ids).encode())
                    state["text"].update(state["utf8"].decode(bits.text(ids)).encode())
                    state["n"] += len(ids)
        if state:
            yield told()

    parts = _long(plain, vocabulary, segment).repartition(tasks(docs.sparkSession), "row").sortWithinPartitions("row", "part")
    return plain.where(F.length("text") <= segment).mapInArrow(short, out).union(parts.mapInArrow(rolling, out)).withColumnRenamed("id", id_col)
