"""Orders of images with many sections against sequential versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.operators import ordering, spectrum, walks


def table(spark, images):
    rows = [(i, int(s), [float(x) for x in v]) for i, (ids, m) in images.items() for s, v in zip(ids, m, strict=True)]
    return spark.createDataFrame(rows, "image_id long, section_id long, vec array<double>")


def series(seed, n, width=12):
    """Thumbnails that drift along a series, in shuffled order of ids."""
    rng = np.random.default_rng(seed)
    m = np.cumsum(rng.normal(size=(n, width)), axis=0) * 0.3 + rng.normal(size=(n, width)) * 0.05
    return rng.permutation(n) + 1, m


def unit(m):
    m = m - m.mean(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def sequential(ids, m):
    order = np.argsort(ids)
    ids, s = np.asarray(ids)[order], np.clip(unit(np.asarray(m))[order] @ unit(np.asarray(m))[order].T, -1, 1)
    np.fill_diagonal(s, 1)
    path = [int(np.argmin(np.round(s.sum(axis=1), 9)))]
    s = np.round(s, 9)
    while len(path) < len(ids):
        row = s[path[-1]].copy()
        row[path] = -9
        path.append(int(np.argmax(row)))
    return [int(ids[k]) for k in path]


@pytest.mark.parametrize("most, block", [(4, 16), (256, 512)])
def test_walks_with_lists_that_run_out_equal_the_sequential_order(spark, most, block):
    ids, m = series(1, 24)
    images = {1: (ids, m), 2: series(2, 9), 3: ([4], [m[0]]), 4: ([7, 5, 6, 2], [m[0], m[0], m[1], m[0]])}
    got = {}
    for r in walks.greedy_order(ordering.thumb_normalise(table(spark, images)), most, block).orderBy("image_id", "position").collect():
        got.setdefault(r.image_id, []).append((r.position, r.section_id))
    for image, (names, rows) in images.items():
        assert got[image] == list(enumerate(sequential(names, rows))), image


def test_no_list_holds_all_pairs(spark):
    from lamella.operators.blocks import packed

    lists = walks.neighbour_lists(packed(ordering.thumb_normalise(table(spark, {1: series(3, 50)})), 8), 5)
    assert lists.count() == 50 and lists.agg(F.max(F.size("near"))).first()[0] == 5


def test_lanczos_over_blocks_equals_eigh(spark):
    images = {1: series(4, 17), 2: series(5, 6), 5: ([3, 1, 2, *range(4, 10)], np.ones((9, 1)) * series(6, 1)[1]), 4: ([1, 2], series(7, 2)[1])}
    got = spectrum.spectral_vectors(ordering.thumb_normalise(table(spark, images)), block=6, steps=30, check=5).collect()
    for image, (ids, m) in images.items():
        mine = {r.section_id: r for r in got if r.image_id == image}
        assert sorted(mine) == sorted(ids)
        if image in (4, 5):  # in 5 all are alike, so that every vector is one
            assert max(r.residual for r in mine.values()) < 1e-6
            continue
        w = np.maximum(np.clip(unit(m) @ unit(m).T, -1, 1), 0)
        np.fill_diagonal(w, 0)
        want = np.linalg.eigh(np.diag(w.sum(axis=1)) - w)[1][:, 1]
        x = np.array([mine[i].x for i in ids])
        assert abs(abs(x @ want) - 1) < 1e-9 and max(r.residual for r in mine.values()) < 1e-5


def test_too_few_steps_show_in_the_residual(spark):
    got = spectrum.spectral_vectors(ordering.thumb_normalise(table(spark, {1: series(8, 20)})), block=8, steps=2)
    assert got.count() == 20 and got.agg(F.min("residual")).first()[0] > 1e-6


def test_orders_of_empty_tables_and_odd_rows(spark):
    none = table(spark, {})
    assert ordering.order_greedy(none).count() == 0 and ordering.order_spectral(none).count() == 0
    odd = spark.createDataFrame([(1, 1, None), (1, 2, [1.0]), (1, 3, []), (1, None, [1.0]), (None, 1, [1.0])], "image_id long, section_id long, vec array<double>")
    assert [r.section_id for r in ordering.order_greedy(odd).orderBy("position").collect()] == [1, 2, 3]
    assert ordering.order_spectral(odd).count() == 3


def test_quality_is_the_mean_of_neighbours_only(spark):
    images = {1: series(9, 12), 2: ([3], series(1, 1)[1])}
    thumbs = table(spark, images)
    order = ordering.order_greedy(thumbs)
    got = {r.image_id: r.quality for r in ordering.order_quality(order, thumbs).collect()}
    ids, m = images[1]
    rows = dict(zip(ids.tolist(), unit(m), strict=True))
    path = sequential(ids, m)
    assert got[2] is None and abs(got[1] - np.mean([rows[a] @ rows[b] for a, b in zip(path, path[1:], strict=False)])) < 1e-9


def test_similarities_are_products_of_blocks(spark):
    """No row of the plan holds both vectors of a pair, which took a Spark expression for each pair."""
    rows = [(k % 3, k, [float((k * 7 + j) % 11) for j in range(4)]) for k in range(30)]
    df = spark.createDataFrame(rows, "image_id long, section_id long, vec array<double>")
    got = ordering.similarity_pairs(df, block=4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "zip_with" not in plan
    u = {k: np.array(v) - np.mean(v) for _, k, v in rows}
    want = {(i, j): 1.0 if i == j else u[i] @ u[j] / np.linalg.norm(u[i]) / np.linalg.norm(u[j]) for i in u for j in u if i % 3 == j % 3}
    have = {(r.i, r.j): r.s for r in got.collect()}
    assert have.keys() == want.keys() and all(abs(have[p] - want[p]) < 1e-12 for p in want)


def test_spectral_steps_take_several_vectors_and_keep_no_matrix(spark, monkeypatch):
    """Steps of one vector took more rounds of jobs (here 30 with their checks), over a matrix that was written."""
    rng, steps, onward, cut = np.random.default_rng(11), [], spectrum._onward, spectrum.cut
    m, written = rng.normal(size=(320, 6)), set()
    monkeypatch.setattr(spectrum, "_onward", lambda *a: steps.append(1) or onward(*a))
    monkeypatch.setattr(spectrum, "cut", lambda df: written.update(df.columns) or cut(df))
    got = {r.section_id: r for r in spectrum.spectral_vectors(ordering.thumb_normalise(table(spark, {1: (range(320), m)})), block=64).collect()}
    w = np.maximum(np.clip(unit(m) @ unit(m).T, -1, 1), 0)
    np.fill_diagonal(w, 0)
    want = np.linalg.eigh(np.diag(w.sum(axis=1)) - w)[1][:, 1]
    assert abs(abs(np.array([got[i].x for i in range(320)]) @ want) - 1) < 1e-9 and got[0].residual < 1e-5
    assert len(steps) <= 20 and "w" not in written


def test_parts_follow_the_products_of_blocks(spark, monkeypatch):
    """All blocks of a part were handed to Python at once, and parts stayed as many whatever came."""
    from lamella.operators import blocks

    monkeypatch.setattr(blocks, "PAIRS", 4)
    thumbs = ordering.thumb_normalise(table(spark, {1: series(12, 50), 2: series(13, 20)}))
    lists = walks.neighbour_lists(blocks.packed(thumbs, 8), 5)  # 7 and 3 blocks: 58 products
    assert lists.rdd.getNumPartitions() == 15 and lists.count() == 70


def test_blocks_are_sent_to_groups_of_blocks(spark, monkeypatch):
    """Every block was sent to every block of its image, so that what was sent grew with the square of the blocks."""
    from pyspark.sql.classic.dataframe import DataFrame

    from lamella.operators import blocks

    sent, map_all = [], DataFrame.mapInPandas
    monkeypatch.setattr(blocks, "GROUPS", 1, raising=False)
    monkeypatch.setattr(DataFrame, "mapInPandas", lambda self, *a, **b: sent.append(self) or map_all(self, *a, **b))
    images = {1: series(14, 80), 2: series(15, 3), 3: series(16, 7)}
    got = {(r.image_id, r.i, r.j): r.s for r in ordering.similarity_pairs(table(spark, images), block=2).collect()}
    assert sent[-1].count() == 40 * 3 + 2 + 4  # 40 * 40 + 2 * 2 + 4 * 4 before
    for image, (ids, m) in images.items():
        s = np.clip(unit(m) @ unit(m).T, -1, 1)
        assert all(abs(got.pop((image, int(a), int(b))) - (1 if a == b else s[i, j])) < 1e-12 for i, a in enumerate(ids) for j, b in enumerate(ids))
    assert not got
    lists = walks.neighbour_lists(blocks.packed(ordering.thumb_normalise(table(spark, images)), 2), 5)
    assert lists.count() == 90 and lists.agg(F.min(F.size("near"))).first()[0] == 2


def test_spectral_steps_hold_few_vectors_and_leave_no_files(spark, monkeypatch):
    """Every step wrote all vectors so far twice, and nothing was removed: the disk grew with the square of the steps."""
    import os

    from lamella.functions import lineage

    wide, onward = [], spectrum._onward
    monkeypatch.setattr(spectrum, "HELD", 40, raising=False)
    monkeypatch.setattr(spectrum, "KEPT", 16, raising=False)
    monkeypatch.setattr(spectrum, "_onward", lambda state, *a: wide.append(state.agg(F.max(F.length("basis") / F.length("degree"))).first()[0]) or onward(state, *a))
    m = np.random.default_rng(17).normal(size=(320, 6))
    top = os.path.dirname(lineage.work_folder(spark, "x"))
    there = set(os.listdir(top))
    got = {r.section_id: r for r in spectrum.spectral_vectors(ordering.thumb_normalise(table(spark, {1: (range(320), m)})), block=64).collect()}
    left = {x for x in os.listdir(top) if x.startswith("round-")} - there
    w = np.maximum(np.clip(unit(m) @ unit(m).T, -1, 1), 0)
    np.fill_diagonal(w, 0)
    want = np.linalg.eigh(np.diag(w.sum(axis=1)) - w)[1][:, 1]
    assert abs(abs(np.array([got[i].x for i in range(320)]) @ want) - 1) < 1e-9 and got[0].residual < 1e-6
    assert len(wide) > 10 and max(wide) <= 40 and len(left) < 20
