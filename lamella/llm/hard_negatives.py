"""Hard negatives by bounds from segment summaries.

For a segment of m components, with means p, q and deviations s, t of two vectors, the
inner product of the segment is m p q plus what the deviations add, which is at most m s t
either way (Cauchy-Schwarz).  The sums over all segments bound the score.  Every vector's
summaries (sum and sum of squares of SEGMENTS segments) are stored beside it; sums of
neighbouring segments give the coarser levels.  A pair of vectors is looked at with one
segment first; pairs that the bounds cannot rule out go on to finer segments, and what is
left is scored exactly, in integers.

Anchors are taken in blocks of at most ANCHORS, which go to every task; the rows are read
where they lie, without a shuffle, and tasks send the few best of each anchor on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import shared_folder, written
from .vectors import finite, lists, scaled

#: Segments of the finest level, and the levels that are tried in turn.
SEGMENTS, LEVELS = 16, (1, 4, 16)
#: Anchors of a block (64 components and summaries take about 1 KB each), and the sides of a block of pairs.
ANCHORS, SIDE, ROWS, PAIRS = 16_384, 2048, 1024, 1 << 16
#: Components beyond this stay at it, so that scores of up to 4096 components fit a long.
MOST = 1 << 25


class Side:
    """Vectors of one length with the means (times the root of a segment's size) and deviations of every level."""

    def __init__(self, rows: np.ndarray, sums: np.ndarray, squares: np.ndarray, label: np.ndarray, ids: np.ndarray):
        self.rows, self.label, self.ids = rows, label, ids
        self.size = max(1, -(-rows.shape[1] // SEGMENTS))
        self.largest = float(np.abs(rows).max(initial=0))
        self.mean, self.dev = {}, {}
        for s in LEVELS:
            total, square = (x.reshape(len(rows), s, SEGMENTS // s).sum(axis=2).astype(float) for x in (sums, squares))
            m = self.size * (SEGMENTS // s)
            self.mean[s] = total / np.sqrt(m)
            self.dev[s] = np.sqrt(np.maximum(square - total * total / m, 0.0))

    def part(self, at) -> Side:  # noqa: ANN001
        out = Side.__new__(Side)
        out.rows, out.label, out.ids, out.size, out.largest = self.rows[at], self.label[at], self.ids[at], self.size, self.largest
        out.mean, out.dev = ({s: x[s][at] for s in LEVELS} for x in (self.mean, self.dev))
        return out


def summaries(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and sum of squares of each of SEGMENTS segments; missing components at the end count as 0."""
    size = max(1, -(-rows.shape[1] // SEGMENTS))
    full = np.zeros((len(rows), size * SEGMENTS), np.int64)
    full[:, : rows.shape[1]] = rows
    cut = full.reshape(len(rows), SEGMENTS, size)
    return cut.sum(axis=2), (cut * cut).sum(axis=2)


def exact(a: Side, x: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs (a[i], x[j])."""
    out = np.empty(len(i), np.int64)
    small = a.largest * x.largest * a.rows.shape[1] < 2**53  # then sums of doubles are exact
    for k in range(0, len(i), PAIRS):
        left, right = a.rows[i[k : k + PAIRS]], x.rows[j[k : k + PAIRS]]
        out[k : k + PAIRS] = np.einsum("ij,ij->i", left.astype(float), right.astype(float)).astype(np.int64) if small else np.einsum("ij,ij->i", left, right)
    return out


def survivors(a: Side, x: Side, low: np.ndarray, high: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Pairs (i, j) of equal (``same``) or different labels whose score may lie in [low[i], high[i]], and how many each level left."""
    slack = 1e-9 * (1 + np.abs(a.mean[1]) @ np.abs(x.mean[1]).T + a.dev[1] @ x.dev[1].T)  # what rounding may take
    centre, reach = a.mean[1] @ x.mean[1].T, a.dev[1] @ x.dev[1].T + slack
    fits = (a.label[:, None] == x.label[None, :]) == same
    i, j = np.nonzero(fits & (centre + reach >= low[:, None]) & (centre - reach <= high[:, None]))
    counts = [len(i)]
    for s in LEVELS[1:]:
        stays = np.empty(len(i), bool)
        for k in range(0, len(i), PAIRS):
            p, q = i[k : k + PAIRS], j[k : k + PAIRS]
            centre = np.einsum("ij,ij->i", a.mean[s][p], x.mean[s][q])
            reach = np.einsum("ij,ij->i", a.dev[s][p], x.dev[s][q]) + slack[p, q]
            stays[k : k + PAIRS] = (centre + reach >= low[p]) & (centre - reach <= high[p])
        i, j = i[stays], j[stays]
        counts.append(len(i))
    return i, j, counts


class Best:
    """The first ``n`` of each group by descending score, then ascending id, as rows come in."""

    def __init__(self, groups: int, n: int):
        self.n, self.least = n, np.full(groups, -np.inf)
        self.group, self.score, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        group, score, ids = (np.concatenate(x) for x in ((self.group, group), (self.score, score), (self.ids, ids)))
        order = np.lexsort((ids, -score, group))
        group = group[order]
        new = np.concatenate([[True], group[1:] != group[:-1]])
        nth = np.arange(len(group)) - np.maximum.accumulate(np.where(new, np.arange(len(group)), 0))
        keep = nth < self.n
        self.group, self.score, self.ids = group[keep], score[order][keep], ids[order][keep]
        last = nth[keep] == self.n - 1
        self.least[self.group[last]] = self.score[last]


def _sides(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, Side]]:
    """The rows of a batch by the length of their vectors: length, places, vectors."""
    size = np.asarray(batch.column("size"))
    for width in np.unique(size):
        at = np.flatnonzero(size == width)
        rows = batch.take(pa.array(at))
        cut = lambda c, w: np.asarray(rows.column(c).flatten()).reshape(len(at), w).astype(np.int64)  # noqa: B023, E731
        yield int(width), at, Side(cut("v", width), cut("sums", SEGMENTS), cut("squares", SEGMENTS), np.asarray(rows.column("label")), np.asarray(rows.column("id")))


def _pairs(anchors: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Side, Side]]:
    """Blocks of anchors (their numbers, vectors) and rows of one length."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            for width, _, rows in _sides(batch.slice(start, ROWS)):
                if width in anchors:
                    numbers, side = anchors[width]
                    for a in range(0, len(numbers), SIDE):
                        yield numbers[a : a + SIDE], side.part(slice(a, a + SIDE)), rows


def hard_negatives(
    vectors: DataFrame, anchors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: float = 256.0, positives: int = 5, negatives: int = 5, least_percent: int = 80, most_percent: int = 100
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: the first ``negatives`` rows of another label than the
    anchor whose score lies between least_percent and most_percent of the positive's, for each anchor and each of its first ``positives``
    rows of the same label.  First are higher scores, then smaller ids; a score is the inner product of floor(scale * x).
    ``anchors`` are rows of ``vectors`` (the same columns), and every row of ``vectors`` is searched.

    Cases: rows without an id, label or vector, or with a component that is null or not finite, take no part.  Rows of the anchor's own id are
    not its positives; otherwise repeated rows count each for itself, as anchors too, so equal rows may come out.  Only vectors of
    one length are compared; without components every score is 0.  An anchor without positives, and a positive without
    negatives (such as one with a negative score), give no row.  Integers beyond MOST stay at MOST.  Other columns are ignored.
    """
    spark = vectors.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("x"))
        return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite("x")).select("id", "label", F.size("x").alias("size"), scaled("x", scale, MOST).alias("v"))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(batch.column("size"))
            sums, squares = np.zeros((2, len(size), SEGMENTS), np.int64)
            for width in np.unique(size):
                at = np.flatnonzero(size == width)
                sums[at], squares[at] = summaries(np.asarray(batch.column("v").take(pa.array(at)).flatten()).reshape(len(at), width).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "label", "size", "v")], lists(sums, pa.int64()), lists(squares, pa.int64())], names=["id", "label", "size", "v", "sums", "squares"])

    stored = "id long, label long, size int, v array<int>, sums array<long>, squares array<long>"
    table = written(usable(vectors).mapInArrow(summarise, stored), "summaries")
    asked = usable(anchors).mapInArrow(summarise, stored)
    asked = written(asked.withColumn("n", F.monotonically_increasing_id()), "anchors")
    # places of anchors in their partition, in steps of a block; blocks of neighbouring steps hold at most ANCHORS
    steps = asked.groupBy(F.shiftright("n", 33).alias("p"), F.floor((F.col("n").bitwiseAND((1 << 33) - 1)) / ANCHORS).alias("k")).count().orderBy("p", "k").collect()
    blocks: list[list] = []
    for r in steps:
        if not blocks or blocks[-1][0] + r["count"] > ANCHORS:
            blocks.append([0, []])
        blocks[-1][0] += r["count"]
        blocks[-1][1].append((r["p"] << 33) + r["k"] * ANCHORS)
    folder = shared_folder(spark, "hard-negatives")
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    for b, (_, starts) in enumerate(blocks):
        inside = F.lit(False)
        for s in starts:
            inside = inside | F.col("n").between(s, min(s + ANCHORS, ((s >> 33) + 1) << 33) - 1)
        block = asked.where(inside).orderBy("n").toArrow().combine_chunks()  # at most ANCHORS rows
        batch = block.to_batches()[0]
        by_width = {width: (at, side) for width, at, side in _sides(batch)}
        own = np.asarray(batch.column("id"))
        sent = spark.sparkContext.broadcast(by_width)

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(len(own), positives)
            for numbers, a, x in _pairs(sent.value, batches):
                i, j, _ = survivors(a, x, best.least[numbers], np.full(len(numbers), np.inf), True)
                other = a.ids[i] != x.ids[j]
                i, j = i[other], j[other]
                best.add(numbers[i], exact(a, x, i, j), x.ids[j])
            yield pa.RecordBatch.from_arrays([pa.array(best.group), pa.array(best.score), pa.array(best.ids)], names=["anchor", "score", "id"])

        def first(found: DataFrame, keys: list[str], n: int) -> DataFrame:
            nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))
            return found.withColumn("nth", nth).where(F.col("nth") <= n)

        chosen = first(table.mapInArrow(near, "anchor long, score long, id long"), ["anchor"], positives).collect()  # at most ANCHORS * positives rows
        if not chosen:
            continue
        low, high = np.full((2, len(own), positives), np.inf)
        high[:] = -np.inf
        p_ids, p_scores = np.zeros((2, len(own), positives), np.int64)
        for r in chosen:
            at = r["anchor"], r["nth"] - 1
            p_ids[at], p_scores[at] = r["id"], r["score"]
            low[at], high[at] = -(-least_percent * r["score"] // 100), most_percent * r["score"] // 100
        sent_limits = spark.sparkContext.broadcast((low, high))

        def hard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, high = sent_limits.value
            best = Best(low.size, negatives)
            for numbers, a, x in _pairs(sent.value, batches):
                lo, hi = low[numbers], high[numbers]
                floor = np.maximum(lo, best.least.reshape(low.shape)[numbers])
                i, j, _ = survivors(a, x, floor.min(axis=1), hi.max(axis=1), False)
                score = exact(a, x, i, j)
                for p in range(low.shape[1]):
                    fits = (score >= floor[i, p]) & (score <= hi[i, p])
                    best.add(numbers[i[fits]] * low.shape[1] + p, score[fits], x.ids[j[fits]])
            yield pa.RecordBatch.from_arrays([pa.array(best.group), pa.array(best.score), pa.array(best.ids)], names=["slot", "score", "id"])

        def named(batches: Iterator[pa.RecordBatch], own: np.ndarray = own, p_ids: np.ndarray = p_ids, p_scores: np.ndarray = p_scores) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                slot = np.asarray(rows.column("slot"))
                cols = [pa.array(own[slot // positives]), pa.array(p_ids.ravel()[slot]), rows.column("nth"), rows.column("id"), pa.array(p_scores.ravel()[slot]), rows.column("score")]
                yield pa.RecordBatch.from_arrays(cols, names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

        found = first(table.mapInArrow(hard, "slot long, score long, id long"), ["slot"], negatives)
        found.mapInArrow(named, out).write.parquet(f"{folder}/block-{b:06d}")
        sent.unpersist()
        sent_limits.unpersist()
    spark.createDataFrame([], out).write.parquet(f"{folder}/none")
    return spark.read.schema(out).parquet(f"{folder}/*")
