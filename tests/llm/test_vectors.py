"""Centroids and hard negatives against brute force, with odd rows."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.llm import centroids, hard_negatives
from lamella.llm.centroids import centroid_clusters, nearest, pivots_of, squared
from lamella.llm.hard_negatives import Best, Side, exact, summaries, survivors

SCHEMA = "vec_id long, embedding array<double>, label int"


def rows_of(n, dims, seed=3, groups=12):
    rng = np.random.RandomState(seed)
    middle = rng.normal(size=(groups, dims))
    return [(k, (middle[k % groups] + 0.4 * rng.normal(size=dims)).tolist(), int(k % groups % 5)) for k in range(n)]


def odd(dims):
    nan, inf = [math.nan] * dims, [math.inf] + [0.0] * (dims - 1)
    return [(None, [0.5] * dims, 1), (9001, None, 1), (9002, [], 1), (9003, nan, 2), (9004, inf, 2), (9005, [None] * dims, 3), (9006, [0.25] * (dims + 1), 1), (9007, [1.0] * dims, None), (9100, [-0.2] * dims, 4), (9100, [-0.2] * dims, 4), (9200, [0.0] * dims, 2), (9300, [1e300] * dims, 0)]


def framed(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(c) for c in ("id", "v", "x", "n", "cluster", "score", "size", "to_pivots")]).repartition(5)


def plain_clusters(rows, dims, k, rounds):
    kept = [(i, [max(-centroids.MOST, min(centroids.MOST, math.floor(64 * x))) for x in v]) for i, v, _ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    means = [v for _, v in named[:k]]
    far = lambda v, m: sum((a - b) ** 2 for a, b in zip(v, m, strict=True))
    pick = lambda v: min(range(len(means)), key=lambda c: (far(v, means[c]), c))
    for _ in range(rounds):
        label = [pick(v) for _, v in kept]
        for c in range(len(means)):
            mine = [v for (_, v), x in zip(kept, label, strict=True) if x == c]
            if mine:
                means[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    label = [pick(v) for _, v in kept]
    out = [(i, c, far(v, means[c])) for (i, v), c in zip(kept, label, strict=True)]
    per = {c: sum(d for _, x, d in out if x == c) for c in range(len(means))}
    return sorted(((-1 if i is None else i), c, d, per[c], sum(per.values()), hashlib.sha256(",".join(map(str, means[c])).encode()).hexdigest()) for i, c, d in out)


@pytest.mark.parametrize(("n", "dims", "k"), [(300, 64, 16), (90, 7, 5), (9, 7, 16)])
def test_clusters_equal_brute_force(spark, n, dims, k):
    rows = [*rows_of(n, dims), *[r for r in odd(dims) if r[0] != 9300]]
    got = centroid_clusters(framed(spark, rows), dims=dims, k=k).collect()
    assert sorted(((-1 if r.vec_id is None else r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == plain_clusters(rows, dims, k, 3)


def test_clusters_of_equal_vectors_and_of_nothing(spark):
    same = [(k, [0.5] * 8, 0) for k in range(50)]
    got = centroid_clusters(spark.createDataFrame(same, SCHEMA), dims=8, k=4).collect()
    assert len(got) == 50 and {r.cluster for r in got} == {0} and {r.inertia for r in got} == {0}
    for rows in ([], [(None, [0.5] * 8, 0)], [(1, [0.5] * 9, 0)]):
        assert centroid_clusters(spark.createDataFrame(rows, SCHEMA), dims=8).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert centroid_clusters(spark.createDataFrame(rows, SCHEMA), dims=8).count() == 0
    wide = centroid_clusters(spark.createDataFrame([(1, [1e300] * 64, 0), (2, [-1e300] * 64, 0)], SCHEMA), k=1, rounds=1).collect()
    assert all(r.distance >= 0 for r in wide)


def test_pivots_bound_and_spare_distances():
    rng = np.random.RandomState(0)
    middle = rng.randint(-800, 800, (16, 8))
    v = (middle[rng.randint(0, 16, 4000)] + rng.randint(-20, 20, (4000, 8))).astype(np.int64)
    pivots = pivots_of(v[:500], 8)
    root = lambda x: np.sqrt(np.column_stack([squared(x, p) for p in pivots]).astype(float))
    label, best, taken = nearest(v, root(v), middle.astype(np.int64), root(middle))
    full = np.column_stack([squared(v, c) for c in middle])
    assert (label == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()
    assert taken < 0.5 * full.size  # most centroids are ruled out by their bounds


def plain_negatives(rows, is_anchor):
    floor = lambda x: max(-hard_negatives.MOST, min(hard_negatives.MOST, math.floor(256 * x) if abs(x) < 1e17 else int(math.copysign(1 << 60, x))))
    kept = [(i, [floor(x) for x in v], c) for i, v, c in rows if i is not None and v is not None and c is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, u, label in kept:
        if not is_anchor(a):
            continue
        met = [(-sum(x * y for x, y in zip(u, v, strict=True)), i, c) for i, v, c in kept if len(v) == len(u)]
        mine = sorted((s, i) for s, i, c in met if c == label and i != a)[:5]
        for s, p in mine:
            hard = sorted((t, i) for t, i, c in met if c != label and 80 * -s <= 100 * -t <= 100 * -s)[:5]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize(("n", "dims"), [(600, 64), (300, 10), (200, 33)])
def test_negatives_equal_brute_force(spark, monkeypatch, n, dims):
    rows = [*rows_of(n, dims), *odd(dims)]
    df = framed(spark, rows)
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(df, df.where("vec_id % 20 = 0")).collect())
    assert got == plain_negatives(rows, lambda i: i % 20 == 0) and got
    monkeypatch.setattr(hard_negatives, "ANCHORS", 7)  # several blocks of anchors
    again = sorted(tuple(r) for r in hard_negatives.hard_negatives(df, df.where("vec_id % 20 = 0")).collect())
    assert again == got


def test_negatives_of_equal_vectors_and_of_nothing(spark):
    rows = [(k, [0.5, 0.5], k % 2) for k in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(df, df.where("vec_id < 4")).collect())
    assert got == plain_negatives(rows, lambda i: i < 4) and len(got) == 4 * 25
    none = spark.createDataFrame([], SCHEMA)
    assert hard_negatives.hard_negatives(none, none).count() == 0 and hard_negatives.hard_negatives(df, none).count() == 0


def test_summaries_bound_scores_and_rule_pairs_out():
    rng = np.random.RandomState(2)
    made = lambda n: np.repeat(rng.randint(-50, 50, (n, 16)), 4, axis=1) + rng.randint(-2, 3, (n, 64))
    side = lambda v: Side(v, *summaries(v), np.zeros(len(v), np.int64), np.arange(len(v)))
    a, x = side(made(40)), side(made(500))
    full = a.rows @ x.rows.T
    low = np.sort(full, axis=1)[:, -5].astype(float)
    i, j, counts = survivors(a, x, low, np.full(40, np.inf), True)
    assert (exact(a, x, i, j) == full[i, j]).all() and (np.bincount(i, minlength=40) >= 5).all()
    wanted = set(zip(*np.nonzero(full >= low[:, None]), strict=True))
    assert wanted <= set(zip(i.tolist(), j.tolist(), strict=True)) and counts[0] >= counts[1] >= counts[2]
    assert counts[2] < 0.1 * full.size
    huge = side(np.full((2, 64), hard_negatives.MOST))
    assert exact(huge, huge, np.array([0]), np.array([1])).tolist() == [64 << 50]


def test_best_keeps_ties_by_id():
    best = Best(2, 2)
    best.add(np.array([0, 0, 1]), np.array([5, 5, 1]), np.array([9, 4, 3]))
    best.add(np.array([0]), np.array([5]), np.array([2]))
    assert sorted(zip(best.group.tolist(), best.ids.tolist(), strict=True)) == [(0, 2), (0, 4), (1, 3)] and best.least.tolist() == [5, -np.inf]
