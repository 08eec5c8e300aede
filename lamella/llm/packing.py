"""Packing token sequences by non-negative least squares over length combinations.

1. Tokenise: full windows are pieces of their own; each text leaves at most one rest,
   whose length (in steps of ``step`` ids) enters a histogram of bounded size.
2. Plan, on the histogram alone: enumerate the shallow combinations of lengths that
   fill a window exactly, solve for non-negative repeat counts by least squares
   (projected gradient with momentum, on a working set), round down.
3. Deal: rests are numbered within their length by two counting rounds in Spark, and a
   number picks its combination, sequence and place by binary search in the plan.
4. What the plan leaves over is packed greedily: laid end to end in id order and cut
   at window borders, so only the last sequence has padding.

The driver sees histograms and partition counts only, never documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbits as tb
from .shared import tasks, written
from .tokens import encoder, with_end

PIECE = "id long, doc_tokens long, start long, length long, ids_crc32 long, tail boolean"


def tokenised(docs: DataFrame, vocabulary: str, window: int, end_id: int) -> DataFrame:
    """Pieces of ``docs(id, text)``: full windows and the rest of each text (tail)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in tb.slices(batches):
            ids, first = with_end(*enc.encode(*tb.text_buffer(batch.column("text"))), end_id)
            n = np.diff(first)
            count = -(-n // window)
            row = np.repeat(np.arange(len(n)), count)
            start = tb.ranges(np.zeros(len(n), np.int64), count) * window
            length = np.minimum(window, n[row] - start)
            raw = memoryview(np.ascontiguousarray(ids, "<u4").tobytes())
            at = (first[row] + start) * 4
            crc = [tb.zlib.crc32(raw[a:z]) for a, z in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(row)), pa.array(n[row]), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(length < window)],
                names=["id", "doc_tokens", "start", "length", "ids_crc32", "tail"],
            )

    return docs.select("id", "text").mapInArrow(run, PIECE)


def combinations(bins: np.ndarray, target: int, depth: int) -> np.ndarray:
    """Ascending combinations (zero-padded rows) of up to ``depth`` of the bins that sum to target."""
    have = np.zeros(target + 1, bool)
    have[bins] = True
    rows = [np.array([[target]])] if have[target] else []
    partial = np.zeros((1, 0), np.int64)
    for d in range(1, depth):
        last = partial[:, -1] if d > 1 else np.zeros(1, np.int64)
        left = target - partial.sum(axis=1)
        grown = [np.column_stack([np.repeat(partial[ok], 1, axis=0), np.full(int(ok.sum()), b)]) for b in bins if (ok := (b >= last) & (left >= 2 * b)).any()]
        if not grown:
            break
        partial = np.concatenate(grown)
        close = target - partial.sum(axis=1)
        good = (close >= partial[:, -1]) & have[np.maximum(close, 0)]
        rows.append(np.column_stack([partial[good], close[good]]))
    if not rows:
        return np.zeros((0, depth), np.int64)
    return np.concatenate([np.pad(r, ((0, 0), (0, depth - r.shape[1]))) for r in rows])


def least_squares(combos: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that makes the combinations' lengths add up to the histogram as nearly as it can.

    Residuals are weighted by 1/sqrt(count), so that rare lengths count too.
    """
    n, depth = combos.shape
    weight = 1 / np.sqrt(np.maximum(histogram, 1.0))
    goal = histogram * weight

    def apply(x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(histogram))
        for d in range(depth):
            total += np.bincount(combos[:, d], weights=x, minlength=len(histogram))
        total[0] = 0
        return total * weight

    def back(r: np.ndarray) -> np.ndarray:
        r = r * weight
        r[0] = 0
        return r[combos].sum(axis=1)

    norm = 1.0  # largest eigenvalue by power iteration, from rounded starts
    v = np.ones(n)
    for _ in range(30):
        v = back(apply(v))
        norm = float(np.linalg.norm(v)) or 1.0
        v /= norm
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(y - back(apply(y) - goal) / (1.05 * norm), 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(histogram: np.ndarray, target: int, depth: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Combinations that are used and how often; no length is used more often than it occurs."""
    combos = combinations(np.flatnonzero(histogram[: target + 1]), target, depth)
    if not len(combos):
        return combos, np.zeros(0, np.int64)
    exact = least_squares(combos, histogram.astype(float))
    repeat = np.floor(exact).astype(np.int64)
    left = histogram.astype(np.int64).copy()
    for d in range(depth):
        left -= np.bincount(combos[:, d], weights=repeat, minlength=len(left)).astype(np.int64)
    left[0] = 0
    # first take back what rounding overdrew, then give out the fractions, the largest first
    for c in np.argsort(exact - repeat, kind="stable") if (left < 0).any() else []:
        parts = combos[c][combos[c] > 0]
        while repeat[c] and (left[parts] < 0).any():
            repeat[c] -= 1
            np.add.at(left, parts, 1)
    for c in np.argsort(repeat - exact, kind="stable"):
        parts, need = np.unique(combos[c][combos[c] > 0], return_counts=True)
        more = int((left[parts] // need).min())
        if more > 0:
            repeat[c] += more
            left[parts] -= more * need
    used = repeat > 0
    return combos[used], repeat[used]


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Adds ``name``: 0, 1, .. within each value of ``group`` in the given order.

    Rows are dealt by ranges of ``order`` and sorted; each partition counts its rows per
    group, the counts become offsets by a window over (partition, group) rows, and the
    place within the partition is added.  No group is gathered in one task.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(tasks(spark), *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    dealt = written(dealt, "ordered")
    from pyspark.sql import Window

    counts = dealt.groupBy(group, "__part").agg(F.count("*").alias("__n"))
    offsets = counts.select(group, "__part", (F.sum("__n").over(Window.partitionBy(group).orderBy("__part")) - F.col("__n")).alias("__before"))
    inner = F.row_number().over(Window.partitionBy("__part", group).orderBy(*order)) - 1
    return dealt.withColumn("__in", inner).join(offsets, [group, "__part"]).withColumn(name, F.col("__in") + F.col("__before")).drop("__part", "__in", "__before")


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, step: int = 8, depth: int = 3, end_id: int = 1) -> DataFrame:
    """Returns one row per piece: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, law``; law tells how the piece was placed (``full``, ``plan`` or ``rest``).

    A text's ids are those of the tokenizer and then ``end_id``.  Each id lies in exactly
    one piece; sequences hold at most ``window`` ids; offsets in a sequence have no gaps.
    ``window`` must be a multiple of ``step``.

    Cases: null and empty texts have the one id ``end_id``.  Rows that repeat are packed
    each for itself; a null id is kept as null.  An empty table gives an empty result.
    A very long text fills windows of its own but for its rest.  Other columns of docs are ignored.
    """
    spark = docs.sparkSession
    if window % step:
        raise ValueError("window must be a multiple of step")
    target = window // step
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = written(tokenised(plain, vocabulary, window, end_id), "pieces")
    bins = pieces.where("tail").select("*", F.ceil(F.col("length") / step).cast("int").alias("bin"))
    histogram = np.zeros(target + 1, np.int64)
    for row in bins.groupBy("bin").count().collect():  # at most window / step rows
        histogram[row["bin"]] = row["count"]
    combos, repeat = plan(histogram, target, depth)

    # the plan as lookup tables: for each bin, the first number of each (combination, place)
    entry_bin, entry_count, entry_combo, entry_place = [], [], [], []
    for c in range(len(combos)):
        for d, b in enumerate(combos[c]):
            if b:
                entry_bin.append(int(b)), entry_count.append(int(repeat[c])), entry_combo.append(c), entry_place.append(d)
    entry_bin, entry_count, entry_combo, entry_place = (np.array(x, np.int64) for x in (entry_bin, entry_count, entry_combo, entry_place))
    order = np.argsort(entry_bin, kind="stable")
    entry_bin, entry_count, entry_combo, entry_place = entry_bin[order], entry_count[order], entry_combo[order], entry_place[order]
    bin_first = np.searchsorted(entry_bin, np.arange(target + 2))
    until = np.concatenate([[0], np.cumsum(entry_count)])
    n_full = pieces.where("not tail").count()
    combo_first = n_full + np.cumsum(repeat) - repeat
    n_plan = int(repeat.sum())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, n = np.asarray(batch.column("bin")).astype(np.int64), np.asarray(batch.column("number"))
            at = until[bin_first[b]] + n
            inside = at < until[bin_first[b + 1]]
            e = np.minimum(np.searchsorted(until, at, "right") - 1, max(len(entry_bin) - 1, 0))
            if len(entry_bin):
                seq = combo_first[entry_combo[e]] + at - until[e]
                slot = entry_place[e]
            else:
                seq = slot = np.zeros(len(b), np.int64)
            cols = {k: batch.column(k) for k in ("id", "doc_tokens", "start", "length", "ids_crc32")}
            yield pa.RecordBatch.from_pydict(cols | {"sequence_id": pa.array(np.where(inside, seq, -1)), "slot": pa.array(slot)})

    from pyspark.sql import Window

    fields = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "law"]
    order_cols = ["id", "start", "length", "ids_crc32"]
    tails = numbered(bins, "bin", ["id", "ids_crc32"], "number").mapInArrow(place, "id long, doc_tokens long, start long, length long, ids_crc32 long, sequence_id long, slot long")
    tails = written(tails, "tails")
    planned = tails.where("sequence_id >= 0")
    mates = Window.partitionBy("sequence_id").orderBy("slot")  # at most `depth` rows each
    planned = planned.withColumn("offset", F.sum("length").over(mates) - F.col("length")).withColumn("law", F.lit("plan")).select(*fields)
    whole = numbered(pieces.where("not tail").withColumn("one", F.pmod(F.xxhash64("id"), F.lit(1))), "one", order_cols, "sequence_id")
    whole = whole.withColumn("offset", F.lit(0).cast("long")).withColumn("law", F.lit("full")).select(*fields)

    # what the plan leaves: end to end, cut at window borders
    left = tails.where("sequence_id < 0").drop("sequence_id", "slot")
    laid = running(left, ["id", "ids_crc32"], "length", "from")
    base = n_full + n_plan
    cut = laid.select("*", F.explode(F.sequence(F.floor(F.col("from") / window), F.floor((F.col("from") + F.col("length") - 1) / window))).alias("w"))
    cut = cut.select(
        "id", "doc_tokens", "start", "length", "ids_crc32", (F.col("w") + base).alias("sequence_id"),
        F.greatest(F.lit(0), F.col("w") * window - F.col("from")).alias("a"), F.least(F.col("length"), (F.col("w") + 1) * window - F.col("from")).alias("z"), F.greatest(F.lit(0), F.col("from") - F.col("w") * window).alias("offset"),
    )
    same = cut.where("z - a = length").select("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", F.lit("rest").alias("law"))
    split = cut.where("z - a < length").select("id", "start", "length", F.col("ids_crc32").alias("whole_crc"), "doc_tokens", "sequence_id", "a", "z", "offset")
    again = split.groupBy("id", "start", "length", "whole_crc").agg(F.sort_array(F.collect_list(F.struct("a", "z", "sequence_id", "offset"))).alias("cuts"), F.first("doc_tokens").alias("doc_tokens"))

    def recut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in tb.slices(batches):
            ids, first = with_end(*enc.encode(*tb.text_buffer(batch.column("text"))), end_id)
            out = []
            for i, row in enumerate(batch.drop_columns(["text"]).to_pylist()):
                mine = ids[first[i] : first[i + 1]]
                lo = row["start"]
                if tb.crc32_ids(mine[lo : lo + row["length"]]) != row["whole_crc"]:
                    continue  # another row with this id
                for c in row["cuts"]:
                    out.append((row["id"], lo + c["a"], c["z"] - c["a"], tb.crc32_ids(mine[lo + c["a"] : lo + c["z"]]), len(mine), c["sequence_id"], c["offset"], "rest"))
            if out:
                kinds = [pa.int64()] * 7 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=fields)

    again = again.withColumnRenamed("id", "wanted")
    texts = plain.join(again, plain["id"].eqNullSafe(again["wanted"])).dropDuplicates(["id", "text", "whole_crc"]).drop("wanted")
    pieces_cut = texts.mapInArrow(recut, "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, law string")
    out = planned.union(whole).union(same.select(*fields)).union(pieces_cut)
    return out.withColumnRenamed("id", id_col)


def running(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows before, in the given order (two rounds, as ``numbered``)."""
    from pyspark.sql import Window

    spark = df.sparkSession
    dealt = written(df.repartitionByRange(tasks(spark), *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()), "ordered")
    sums = [(r["__part"], r["s"]) for r in dealt.groupBy("__part").agg(F.sum(value).alias("s")).collect()]  # one row per partition
    before, total = [], 0
    for part, s in sorted(sums):
        before.append((part, total))
        total += int(s)
    offsets = spark.createDataFrame(before, "__part int, __before long")
    within = F.sum(value).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    return dealt.withColumn(name, within).join(offsets, "__part").withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before")
