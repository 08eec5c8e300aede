"""Clusters of images that lie in one piece each, for many at a time: batches of sorted areas, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that are looked at together, if no image has more.
TOGETHER = 1 << 16
#: Rows that one task sorts.
TASK_ROWS = 1 << 20
LAST = np.iinfo("i8").max


def _above(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a > b as Spark tells it: NaN is above all numbers and equal to itself."""
    return (a > b) | (np.isnan(a) & ~np.isnan(b))


def _sorted(base: DataFrame, per: DataFrame, min_samples: list[int | Column]) -> DataFrame:
    """The rows of the images of ``per`` in order, an image's eps beside its first row; least: per min_samples the eps that makes a core."""
    parts = max(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-base.count() // TASK_ROWS))
    rows = base.repartition(parts, "image_id").join(per, "image_id").sortWithinPartitions("image_id", "rank")
    least = [F.get("near", (m if isinstance(m, Column) else F.lit(m)) - 1) for m in min_samples]
    first, i = F.when(F.col("rank") == 0, F.col("eps")), F.coalesce(F.col("idx").cast("long"), F.lit(int(LAST)))
    prints = [F.xxhash64("idx").alias("x"), F.xxhash64("idx", F.lit(1)).alias("y")]
    return rows.select("image_id", "idx", "area", i.alias("i"), *prints, first.alias("eps"), *[v.alias(f"least{j}") for j, v in enumerate(least)])


def _images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole images."""
    held, n, enough = [], 0, TOGETHER
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= enough:
            table = pa.Table.from_batches(held).combine_chunks()
            last = int(np.flatnonzero(table["eps"].is_valid().to_numpy())[-1])
            if last:
                yield table.slice(0, last)
            held = table.slice(last).to_batches()
            n = table.num_rows - last
            enough = max(TOGETHER, 2 * n)
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _trials(table: pa.Table, k: int) -> Iterator[tuple]:
    """(trial, eps by image, image of a row, cluster of a row or -1, least core index, image, count and prints of a cluster), eps outer."""
    n, rows = table.num_rows, np.arange(table.num_rows)
    lists = table["eps"].combine_chunks()
    starts = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
    sizes = np.diff(np.append(starts, n))
    image = np.repeat(np.arange(len(starts)), sizes)
    start, end = np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)
    every = [np.asarray(v, float) for v in lists.drop_null().to_pylist()]
    steps = np.array([len(v) for v in every])
    tried = np.full((len(every), steps.max()), np.nan)
    for row, v in zip(tried, every, strict=True):
        row[: len(v)] = v
    area, i, x, y = (table[c].to_numpy() for c in ("area", "i", "x", "y"))
    least = [(table[f"least{j}"].to_numpy(), table[f"least{j}"].is_valid().to_numpy()) for j in range(k)]
    for s in range(steps.max()):
        eps, part = tried[image, s], steps[image] > s
        for j, (reach, known) in enumerate(least):
            core = part & known & ~_above(reach, eps)
            before = np.append(-1, np.maximum.accumulate(np.where(core, rows, -1))[:-1])
            after = np.minimum.accumulate(np.where(core, rows, n)[::-1])[::-1]
            low, high = area[before], area[np.minimum(after, n - 1)]
            below = (before >= start) & ~_above(area - low, eps)
            above = (after < end) & ~_above(high - area, eps)
            began = np.maximum.accumulate(np.where(core & ~below, rows, -1))
            run = np.where(core | below, began, np.where(above, after, -1))
            open_ = ~core & below & above & _above(high - low, eps)
            found_in = np.flatnonzero(run >= 0)
            cluster = np.full(n, -1)
            if not len(found_in):
                none = np.empty(0, "i8")
                yield s * k + j, tried[:, s], image, cluster, none, none, none, none, none
                continue
            names, mine = np.unique(run[found_in], return_inverse=True)
            heads = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))  # runs lie one after another
            found = np.minimum.reduceat(np.where(core, i, LAST)[found_in], heads)
            cluster[found_in] = mine
            # rows that reach two clusters go to the one found first
            two = np.flatnonzero(open_)
            other = np.searchsorted(names, after[two])
            up = found[other] < found[cluster[two]]
            cluster[two[up]] = other[up]
            of = cluster[found_in]
            count = np.bincount(of, minlength=len(names))
            prints = []
            for v in (x, y):
                p = np.zeros(len(names), "i8")
                moved = of != mine
                p[:] = np.bitwise_xor.reduceat(np.where(moved, 0, v[found_in]), heads)
                np.bitwise_xor.at(p, of[moved], v[found_in][moved])
                prints.append(p)
            yield s * k + j, tried[:, s], image, cluster, found, image[names], count, *prints


def _found(found: np.ndarray) -> pa.Array:
    return pa.array(found, mask=found == LAST)


def largest(base: DataFrame, per: DataFrame, min_samples: list[int]) -> DataFrame:
    """``clustering.largest`` of images of one piece."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _images(batches):
            firsts = table["image_id"].filter(table["eps"].is_valid()).combine_chunks()
            for trial, eps, _, _, found, image, count, x, y in _trials(table, len(min_samples)):
                order = np.lexsort((found, -count, image))
                order = order[np.append(True, image[order][1:] != image[order][:-1])] if len(order) else order
                at = image[order]
                columns = [firsts.take(pa.array(at)), pa.array(np.full(len(at), trial, "i4")), _found(found[order]), pa.array(eps[at]), pa.array(count[order]), pa.array(x[order]), pa.array(y[order])]
                yield pa.RecordBatch.from_arrays(columns, names=["image_id", "trial", "found", "eps", "n", "x", "y"])

    out = _sorted(base, per, min_samples).mapInArrow(best, f"image_id {base.schema['image_id'].dataType.simpleString()}, trial int, found long, eps double, n long, x long, y long")
    return out.withColumn("found", F.col("found").cast(base.schema["idx"].dataType))


def clusters(base: DataFrame, per: DataFrame, min_samples: int | Column) -> DataFrame:
    """``clustering.clusters`` of images of one piece, with labels."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _images(batches):
            _, _, _, cluster, found, image, *_ = next(_trials(table, 1))
            order = np.lexsort((found, image))
            ranks = np.empty(len(found), "i8")
            ranks[order] = np.arange(len(found)) - np.searchsorted(image, image[order])
            noise = cluster < 0
            at = np.where(noise, 0, cluster)
            found, ranks = (found, ranks) if len(found) else (np.zeros(1, "i8"), np.zeros(1, "i8"))
            labels = np.where(noise, -1, ranks[at])
            columns = [table[c].combine_chunks() for c in ("image_id", "idx", "area")] + [pa.array(found[at], mask=noise | (found[at] == LAST)), pa.array(labels)]
            yield from pa.Table.from_arrays(columns, names=["image_id", "idx", "area", "found", "label"]).to_batches(10_000)

    kinds = {c: base.schema[c].dataType.simpleString() for c in ("image_id", "idx", "area")}
    out = _sorted(base, per, [min_samples]).mapInArrow(label, ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", found long, label long")
    return out.withColumn("found", F.col("found").cast(kinds["idx"]))
