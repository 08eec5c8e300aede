"""Clustering and percentiles of images that lie in many pieces, against sequential versions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.operators import calibration, clustering, filters, ranks

from test_operators import queue_dbscan


def table(spark, areas):
    return spark.createDataFrame([(image, i, a) for image, xs in areas.items() for i, a in enumerate(xs)], "image_id long, idx long, area double")


def draw(seed, top=70):
    rng = random.Random(seed)
    return {image: [float(rng.randrange(top)) for _ in range(rng.choice([1, 4, 25, 60]))] for image in range(14)}


@pytest.mark.parametrize("least, eps, piece", [(1, 0.0, 3), (3, 1.0, 4), (4, 2.0, 4), (5, 2.0, 7)])
def test_dbscan_over_many_pieces(spark, least, eps, piece):
    areas = draw(least)
    got = {(r.image_id, r.idx): r.label for r in clustering.area_dbscan(table(spark, areas), eps, least, piece).collect()}
    assert got == {(image, i): x for image, xs in areas.items() for i, x in enumerate(queue_dbscan(xs, eps, least))}


def sweep(areas, trials):
    seen = {}
    for eps, least in trials:
        labels = queue_dbscan(areas, eps, least)
        sets = {x: tuple(i for i, y in enumerate(labels) if y == x) for x in labels if x >= 0}
        if sets:
            best = min(sets.items(), key=lambda kv: (-len(kv[1]), kv[0]))[1]
            votes, first = seen.get(best, (0, (eps, least)))
            seen[best] = (votes + 1, first)
    if not seen:
        return set()
    members, (_, (eps, least)) = max(seen.items(), key=lambda kv: kv[1][0])
    return {(i, eps, least) for i in members}


def test_sweep_over_many_pieces(spark):
    areas, eps, least = draw(9), [0.0, 1.0, 2.0, 3.0], [1, 2, 4]
    got = {}
    for r in clustering.area_sweep_consensus(table(spark, areas), eps, least, piece=5).collect():
        got.setdefault(r.image_id, set()).add((r.idx, r.eps, r.min_samples))
    assert got == {image: sweep(xs, [(e, m) for e in eps for m in least]) for image, xs in areas.items()}


def test_no_piece_is_longer_than_stated_and_bad_areas_are_noise(spark):
    xs = [None, float("nan"), 5.0, 5.0, 6.0, None, float("nan")] + [100.0 + i for i in range(200)]
    masks = table(spark, {1: xs})
    sizes = [r["count"] for r in clustering.pieces(masks, 3, 16).groupBy("piece").count().collect()]
    assert max(sizes) == 16 and sum(sizes) == len(xs)
    labels = {r.idx: r.label for r in clustering.area_dbscan(masks, 1.0, 2, 16).collect()}
    assert [labels[i] for i in range(7)] == [-1, -1, 0, 0, 0, -1, -1] and {labels[i] for i in range(7, 207)} == {1}


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(2)
    values = {k: rng.integers(0, 50, n).astype(float) for k, n in enumerate([1, 2, 7, 500])}
    rows = spark.createDataFrame([(k, float(v)) for k, xs in values.items() for v in xs] + [(9, None)], "image_id long, v double")
    got = {r.image_id: (r.a, r.b) for r in ranks.percentiles(rows, "v", {"a": 0.5, "b": 0.995}).collect()}
    assert got.keys() == values.keys()
    for k, xs in values.items():
        assert got[k] == pytest.approx((np.percentile(xs, 50), np.percentile(xs, 99.5)))


def test_contrast_cuts_take_the_upper_cut_among_smaller_values(spark):
    values = {1: [1] * 90 + [2] * 8 + [9] * 2, 2: [4], 3: list(range(1000))}
    pixels = spark.createDataFrame([(k, i, 0, v) for k, xs in values.items() for i, v in enumerate(xs)], "image_id long, x long, y long, v long")
    for r in calibration.contrast_cuts(pixels).collect():
        xs = np.array(values[r.image_id])
        lo, hi = np.percentile(xs, 1), np.percentile(xs, 99.5)
        if hi >= xs.max() and (xs < xs.max()).any():
            hi = np.percentile(xs[xs < xs.max()], 99.5)
        assert (r.lo, r.hi) == pytest.approx((lo, hi if hi > lo else lo + 1))


def test_positions_by_area_keep_the_columns(spark):
    rows = spark.createDataFrame([(1, 7, 2.0, "a"), (1, 3, 5.0, "b"), (1, 2, 5.0, "c"), (2, 1, 1.0, "d")], "image_id long, mask_id long, area double, note string")
    out = filters.masks_by_area(rows)
    assert out.columns == [*rows.columns, "position"]
    assert {(r.mask_id, r.position, r.note) for r in out.collect()} == {(2, 0, "c"), (3, 1, "b"), (7, 2, "a"), (1, 0, "d")}


def test_sweep_tasks_follow_the_rows_times_the_steps(spark, monkeypatch):
    monkeypatch.setattr(clustering, "TASK_ROWS", 100)
    masks = spark.range(60).selectExpr("id % 20 as image_id", "id as idx", "cast(id * 7 % 13 as double) as area")
    per = masks.select("image_id").distinct().withColumn("eps", F.array(*[F.lit(float(e)) for e in range(20)]))
    rows = clustering.assigned(clustering.pieces(masks, 2), per, [1, 2])
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"RepartitionByExpression \[image_id#\d+L?, piece#\d+L?, step#\d+\], 12", plan)  # 60 rows of 20 steps


@pytest.mark.parametrize("together", [16, 1 << 16])
def test_images_of_one_piece_take_no_windows(spark, monkeypatch, together):
    """Rows were repeated by every eps and went through sorts and windows, however small the images were."""
    from lamella.operators import sweeps

    monkeypatch.setattr(sweeps, "TOGETHER", together)
    areas, eps, least = draw(21) | {20: [5.0, float("nan"), 6.0, None, 7.0]}, [0.0, 1.0, 2.0, 3.0], [1, 2, 4]
    masks = table(spark, areas)
    per = masks.select("image_id").distinct().withColumn("eps", F.array(*[F.lit(e) for e in eps]))
    base = clustering.pieces(masks, 4)
    plan = clustering.largest(base, per, least)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan
    columns = ["image_id", "trial", "found", "eps", "n", "x", "y"]
    assert {tuple(r) for r in clustering.largest(base, per, least).select(columns).collect()} == {tuple(r) for r in clustering._wide_largest(base, per, least).select(columns).collect()}
    got = {}
    for r in clustering.area_sweep_consensus(masks, eps, least).where("image_id < 20").collect():
        got.setdefault(r.image_id, set()).add((r.idx, r.eps, r.min_samples))
    assert got == {image: sweep(xs, [(e, m) for e in eps for m in least]) for image, xs in areas.items() if image < 20}
    labels = {(r.image_id, r.idx): r.label for r in clustering.area_dbscan(masks, 1.0, 3).where("image_id < 20").collect()}
    assert labels == {(image, i): x for image, xs in areas.items() if image < 20 for i, x in enumerate(queue_dbscan(xs, 1.0, 3))}
