"""Operators against small sequential versions and hand-computed values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.functions import polygons as poly
from lamella.operators import calibration, clustering, edits, filters, frames, ordering, planning, spatial
from lamella.plans.fixtures import Fixtures
from lamella.sources import annotations, metadata, projects


def sections(spark, rows):
    return spark.createDataFrame(rows, "image_id long, mask_id long, tile_idx long, area double, cx double, cy double")


@pytest.mark.parametrize("seed", [1, 2])
def test_dedup_equals_the_sequential_pass(spark, seed):
    rng = random.Random(seed)
    rows = [(i % 3, i, rng.randrange(4), float(rng.choice([1, 25, 400, 10000])), float(rng.randrange(60)), float(rng.randrange(60))) for i in range(150)]
    kept = {r.mask_id for r in spatial.cross_tile_dedup(sections(spark, rows)).collect()}
    want = set()
    for image in range(3):
        seen = []
        for r in sorted((r for r in rows if r[0] == image), key=lambda r: (r[2], -r[3], r[1])):
            reach = 0.5 * math.sqrt(max(r[3], 1))
            if not any(abs(r[4] - x) < reach and abs(r[5] - y) < reach for x, y in seen):
                seen.append((r[4], r[5]))
                want.add(r[1])
    assert kept == want


def test_dedup_is_strict_at_the_distance_and_needs_no_nested_loop(spark):
    rows = [(1, 1, 0, 100.0, 0.0, 0.0), (1, 2, 1, 100.0, 5.0, 0.0), (1, 3, 1, 100.0, 4.9, 0.0)]
    assert {r.mask_id for r in spatial.cross_tile_dedup(sections(spark, rows)).collect()} == {1, 2}
    points = sections(spark, rows).selectExpr("mask_id as id", "image_id", "1 as rank", "cx as x", "cy as y", "5.0D as r")
    plan = spatial.conflict_edges(points)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_click_plan_has_no_nested_loop(spark, small):
    fx = Fixtures(spark, small)
    plan = spatial.click_to_section(fx.clicks, fx.sections)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def queue_dbscan(areas, eps, least):
    near = [[j for j, b in enumerate(areas) if abs(a - b) <= eps] for a in areas]
    labels, label = [None] * len(areas), -1
    for i in range(len(areas)):
        if labels[i] is not None or len(near[i]) < least:
            continue
        label += 1
        todo = [i]
        while todo:
            j = todo.pop()
            if labels[j] is None:
                labels[j] = label
                if len(near[j]) >= least:
                    todo += [k for k in near[j] if labels[k] is None]
    return [-1 if x is None else x for x in labels]


@pytest.mark.parametrize("seed", range(3))
def test_dbscan_equals_the_queue_version(spark, seed):
    rng = random.Random(seed)
    areas = {image: [float(rng.randrange(60)) for _ in range(rng.choice([1, 5, 40]))] for image in range(6)}
    rows = [(image, i, a) for image, xs in areas.items() for i, a in enumerate(xs)]
    df = spark.createDataFrame(rows, "image_id long, idx long, area double")
    got = {(r.image_id, r.idx): r.label for r in clustering.area_dbscan(df, 2.0, 3).collect()}
    assert got == {(image, i): x for image, xs in areas.items() for i, x in enumerate(queue_dbscan(xs, 2.0, 3))}


def test_finalize_is_empty_without_a_cluster_and_keeps_small_bands(spark):
    df = spark.createDataFrame([(1, 0, 5.0), (1, 1, 6.0), (2, 0, 1.0), (2, 1, 1e6), (2, 2, 3e6)], "image_id long, idx long, area double")
    got = {(r.image_id, r.idx) for r in clustering.finalize_sections(df, min_samples=(4,)).collect()}
    assert got == {(1, 0), (1, 1)}


def test_spectral_order_equals_eigh(spark, small):
    thumbs = Fixtures(spark, small).thumbs.where("image_id < 2 and section_id < 200")
    order, sim = ordering.order_sections(thumbs, "spectral")
    got = {}
    for r in order.orderBy("image_id", "position").collect():
        got.setdefault(r.image_id, []).append(r.section_id)
    for image, mine in got.items():
        ids = sorted(mine)
        m = np.zeros((len(ids), len(ids)))
        for r in sim.where(F.col("image_id") == image).collect():
            m[ids.index(r.i), ids.index(r.j)] = max(r.s, 0)
        np.fill_diagonal(m, 0)
        _, v = np.linalg.eigh(np.diag(m.sum(axis=1)) - m)
        want = [ids[k] for k in np.argsort(v[:, 1])]
        assert mine in (want, want[::-1])


def test_ordering_handles_one_and_two_sections_nan_and_constant(spark):
    rows = [(1, 1, [1.0, 2.0]), (2, 1, [1.0, 3.0]), (2, 2, [3.0, 1.0]), (3, 1, [5.0, 5.0]), (3, 2, [float("nan"), 1.0]), (3, 3, [1.0, 0.0])]
    thumbs = spark.createDataFrame(rows, "image_id long, section_id long, vec array<double>")
    assert ordering.thumb_normalise(thumbs.where("image_id = 3 and section_id = 1")).first().vec == [0.0, 0.0]
    order, sim = ordering.order_sections(thumbs)
    assert order.count() == 6 and ordering.order_spectral(thumbs).count() == 6
    with pytest.raises(ValueError):
        ordering.order_sections(thumbs, "other")


def test_frames_invert_each_other(spark, small):
    fx = Fixtures(spark, small)
    geometry = frames.geometry_of(fx.images)
    shapes = fx.sections.select("image_id", "mask_id", "polygon")
    back = frames.to_overview(frames.to_fullres(shapes, geometry), geometry).select("mask_id", F.col("polygon").alias("q"))
    worst = shapes.join(back, "mask_id").select(F.array_max(F.zip_with("polygon", "q", lambda a, b: F.abs(a["x"] - b["x"]) + F.abs(a["y"] - b["y"]))).alias("e")).agg(F.max("e")).first()[0]
    assert worst < 1e-6
    stage = frames.from_stage_um(frames.to_stage_um(shapes, geometry), geometry)
    assert stage.where("polygon is null").count() > 0 and stage.where("polygon is not null").count() > 0


def test_polygons(spark):
    df = spark.sql("select array(named_struct('x', 0D, 'y', 0D), named_struct('x', 4D, 'y', 0D), named_struct('x', 4D, 'y', 2D), named_struct('x', 0D, 'y', 2D)) as p, array(named_struct('x', 1D, 'y', 1D)) as q, cast(null as array<struct<x: double, y: double>>) as n")
    row = df.select(
        poly.area("p").alias("a"), poly.minor_axis("p").alias("m"), poly.minor_area("p").alias("r"), poly.area("q").alias("z"), poly.minor_axis("q").alias("mz"), poly.valid("n").alias("v"),
        poly.contains("p", F.lit(4.0), F.lit(1.0)).alias("edge"), poly.contains("p", F.lit(2.0), F.lit(1.0)).alias("inside"), poly.contains("p", F.lit(4.1), F.lit(1.0)).alias("out"), F.size(poly.resample("p", 3)).alias("k"),
    ).first()
    assert (row.a, row.m, row.r, row.z, row.mz, row.v, row.edge, row.inside, row.out, row.k) == (8.0, 2.0, 8.0, 0.0, 0.0, False, True, True, False, 3)


def test_tile_plan_rounds_half_to_even(spark):
    images = spark.createDataFrame([(1, 2560, 1000)], "image_id long, size_x long, size_y long")
    tiles = planning.tile_plan(images, 1024, 0.25).orderBy("tile_idx").collect()
    assert [(t.x0, t.w) for t in tiles] == [(0, 1440), (1120, 1440)]  # 2.5 tiles become 2
    assert planning.tile_plan(images, 5000).count() == 1


def test_calibration_without_examples_is_an_error_row(spark):
    examples = spark.createDataFrame([], "image_id long, polygon array<struct<x: double, y: double>>")
    settings = spark.createDataFrame([(1, None, None, None, None, None)], "image_id long, zoom double, ov_given double, tile_cap long, batch long, model string")
    row = calibration.calibrate(examples, settings).first()
    assert row.error and row.n_examples == 0 and row.tile_px is None


def test_second_pass_scales_sizes_not_corners(spark):
    """96 by 192 at a third: 2048 exactly, wherever the rectangle lies, so that 32 points a side are enough."""
    box = "array(named_struct('x', a, 'y', b), named_struct('x', a + 96, 'y', b), named_struct('x', a + 96, 'y', b + 192), named_struct('x', a, 'y', b + 192))"
    examples = spark.range(100).selectExpr("id as image_id", "cast(id as double) as a", "cast(id * 3 % 11 as double) as b").selectExpr("image_id", f"{box} as polygon")
    settings = spark.range(100).selectExpr("id as image_id", "1.0e0 as zoom", "3072.0e0 as ov_given", "cast(null as long) as tile_cap", "cast(null as long) as batch", "cast(null as string) as model", "true as is_slide")
    rows = calibration.calibrate_two_pass(examples, settings).collect()
    assert {(r["pass"], r.pps, r.median_area) for r in rows} == {(2, 32.0, 2048.0)}


def test_contrast_cuts_of_a_flat_image(spark):
    df = spark.createDataFrame([(1, 0, 0, 7), (1, 1, 0, 7)], "image_id long, x long, y long, v long")
    assert tuple(calibration.contrast_cuts(df).first()) == (1, 7.0, 8.0)


def test_quality_gate_bounds(spark):
    df = spark.createDataFrame([(1, 0.7, 0.92), (2, 0.71, 0.92), (3, 0.71, 0.919)], "mask_id long, pred_iou double, stability double")
    assert [r.mask_id for r in filters.quality_gate(df).collect()] == [2]


def test_broken_documents_give_no_rows(spark):
    docs = spark.createDataFrame([(1, "<a><Polygon Id='1'>"), (2, None), (3, "<a><Polygon><Geometry><Points>1,2 3,4</Points></Geometry></Polygon></a>"), (4, "no xml")], "image_id long, xml string")
    assert annotations.annotation_xml_read(docs).count() == 0
    assert metadata.stage_markers_read(docs).count() == 0
    assert metadata.image_metadata_read(docs).count() == 4
    jsons = spark.createDataFrame([(1, "{broken"), (2, '{"fiducials": [[1, 2]]}'), (3, "{}")], "image_id long, json string")
    rows = projects.project_read(jsons).collect()
    assert [(r.image_id, r.layer) for r in rows] == [(2, "fiducials")]


def test_files_round_trip(spark, tmp_path):
    rows = spark.sql("select 'w1' as image_id, 'sections' as layer, 0L as idx, array(named_struct('x', 0D, 'y', 0D), named_struct('x', 4D, 'y', 0D), named_struct('x', 4D, 'y', 2D)) as polygon")
    out = projects.project_write(rows).first()
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "w1_stim_project.json").write_text(out.json)
    back = projects.project_read(projects.read_projects(spark, str(tmp_path / "p"))).first()
    assert (back.image_id, back.layer, back.polygon) == ("w1", "sections", rows.first().polygon)
    csv = annotations.coords_csv_rows(rows.withColumn("section_id", F.lit("section_1")), spark.createDataFrame([], "image_id string, idx long, x double, y double"), spark.createDataFrame([], "image_id string, name string, distance double"))
    annotations.coords_csv_write(csv, str(tmp_path / "csv"))
    read = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    lines = read.select("image_id", F.monotonically_increasing_id().alias("line"), "type", "contour_coordinates")
    assert annotations.legacy_csv_read(lines).where("kind = 'section'").first().polygon == rows.first().polygon
    assert projects.image_manifest(projects.list_files(spark, str(tmp_path / "p")).withColumn("path", F.lit("/a/b.CZI"))).first().is_slide


def test_edit_replay_ignores_needless_removals(spark):
    df = spark.createDataFrame([(1, 5, 1, "remove", None), (1, 5, 2, "add", "a"), (1, 6, 3, "add", "b"), (1, 6, 4, "remove", None), (1, 6, 5, "remove", None)], "image_id long, key long, seq long, op string, value string")
    assert [(r.key, r.value) for r in edits.edit_replay(df).collect()] == [(5, "a")]


def test_empty_tables(spark):
    empty = sections(spark, [])
    assert spatial.cross_tile_dedup(empty).count() == 0
    assert clustering.area_dbscan(empty.selectExpr("image_id", "mask_id as idx", "area"), 1.0, 2).count() == 0
    assert filters.masks_by_area(empty).count() == 0


def test_least_rectangle_of_polygons_of_many_vertices(spark):
    rng, rows, want = np.random.default_rng(1), [], []
    for k, n in enumerate([65, 200, 300]):
        turn = np.linspace(0, 2 * np.pi, n, endpoint=False)
        ring = np.stack([90 * np.cos(turn), 30 * np.sin(turn)], 1) * rng.uniform(0.8, 1, (n, 1)) @ np.array([[0.8, 0.6], [-0.6, 0.8]])
        rows.append((k, [(float(x), float(y)) for x, y in ring]))
        i, j = np.triu_indices(n, 1)
        d = (ring[j] - ring[i]) / np.hypot(*(ring[j] - ring[i]).T)[:, None]
        u, v = np.ptp(d @ ring.T, axis=1), np.ptp(d @ np.array([[0, 1], [-1, 0]]) @ ring.T, axis=1)
        best = np.argmin(u * v)
        want.append((u[best] * v[best], min(u[best], v[best])))
    got = spark.createDataFrame(rows, "k long, p array<struct<x: double, y: double>>").select("k", poly.minor_area("p").alias("r"), poly.minor_axis("p").alias("m")).orderBy("k").collect()
    for row, (rect, short) in zip(got, want, strict=True):
        assert row.r == pytest.approx(rect, abs=1e-5) and row.m == pytest.approx(short)


def test_prompt_grid_thins_on_request_only(spark):
    tiles = spark.createDataFrame([(1, 0, 0, 0, 900, 900), (1, 1, 900, 0, 900, 900)], "image_id long, tile_idx long, x0 long, y0 long, w long, h long")
    assert planning.prompt_grid(tiles, 90).count() == 2 * 8100
    assert planning.prompt_grid(tiles, 90, most=6000).count() == 2 * 4050


def test_distances_of_one_large_image_are_many_tasks(spark):

    df = spark.range(1, 1501).selectExpr("id div 5000 as image_id", "id as idx", "id * 1.0e0 as x", "0.0e0 as y")
    got = spatial.fiducial_distances(df)
    sizes = [n for n in got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert sum(sizes) == 1500 * 1499 // 2 and len(sizes) > 1
    assert got.agg(F.sum("distance")).first()[0] == sum(d * (1500 - d) for d in range(1, 1500))


def test_csv_distances_are_sorted_in_ranges(spark):


    dots = spark.range(0, 41).selectExpr("if(id = 40, 8, 7) as image_id", "if(id = 40, 1, id + 1) as idx", "id * 1.0e0 as x", "0.0e0 as y")
    shapes = spark.createDataFrame([], "image_id long, section_id string, polygon array<struct<x: double, y: double>>")
    rows = annotations.coords_csv_rows(shapes, dots, spatial.fiducial_distances(dots))
    entries = sorted(f'"fiducial_{i}-fiducial_{j}": {float(j - i)}' for i in range(1, 41) for j in range(i + 1, 41))
    assert {r.image_id: r.distance for r in rows.collect()} == {7: "{" + ", ".join(entries) + "}", 8: ""}
    # what is collected in an image are the texts of ranges
    assert "range#" in rows._jdf.queryExecution().optimizedPlan().toString()


def test_points_probe_few_cells_in_few_grids(spark):
    """Rows on both sides of the join: formerly nine probes, and a grid for each power of two."""
    from lamella.operators.spatial import conflict_edges

    rng = random.Random(5)
    rows = [(k, 1, k, rng.uniform(-300, 300), rng.uniform(-300, 300), 2.0 ** rng.uniform(-1, 6.9)) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, image_id long, rank long, x double, y double, r double")
    got = {(e.later, e.earlier) for e in conflict_edges(df).collect()}
    assert got == {(a[0], b[0]) for a in rows for b in rows if b[2] < a[2] and abs(a[3] - b[3]) < a[5] and abs(a[4] - b[4]) < a[5]}
    plan = conflict_edges(df)._jdf.queryExecution().optimizedPlan().toString()
    cls = df.selectExpr("2 * ceil((log2(r) + 1) / 2) as c").distinct().count()
    assert cls <= 5 and "array(-1, 0, 1)" not in plan and "[-1,0,1]" not in plan


def test_freshness_tasks_follow_the_levels(spark, monkeypatch):
    """The parts stayed as many, so a task's table of levels grew with the input."""
    monkeypatch.setattr(edits, "TASK_ROWS", 10)
    m = spark.range(30).selectExpr("id as image_id", "true as complete", "3L as n_levels", "id as size", "0.5D as mtime")
    levels = m.selectExpr("image_id", "explode(sequence(0, if(image_id % 5 = 2, 1, 2))) as level")
    levels = levels.union(levels.where("image_id % 5 = 2")).union(levels.where("image_id = 2").selectExpr("image_id", "level + 7"))
    got = edits.pyramid_freshness(m, levels, m.where("image_id <> 9"))
    assert {r.image_id for r in got.where("not fresh").collect()} == {2, 7, 9, 12, 17, 22, 27}
    assert "image_id" in got.columns and "RepartitionByExpression" in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and ", 10\n" in plan


def test_csv_distances_are_made_where_their_row_is(spark):
    """Pairs were rows, written, sorted and sent as texts; now only fiducials travel, and each image's texts are a task's own."""
    dots = spark.range(0, 31).selectExpr("if(id = 30, 8, 7) as image_id", "if(id = 30, 1, id + 1) as idx", "if(id = 4, null, id * 1.5e0) as x", "id * id * 0.1e0 as y")
    twice = spark.createDataFrame([(9, k, float(x), 0.0) for k, x in ((1, 0), (1, 5), (2, 7), (10, 9), (None, 3))], "image_id long, idx long, x double, y double")
    shapes = spark.createDataFrame([], "image_id long, section_id string, polygon array<struct<x: double, y: double>>")
    for fiducials in (dots, twice):
        made = annotations.coords_csv_rows(shapes, fiducials)
        want = annotations.coords_csv_rows(shapes, fiducials, spatial.fiducial_distances(fiducials))
        assert sorted(map(tuple, made.collect())) == sorted(map(tuple, want.collect()))
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "fiducial_" in plan and "(i#" not in plan and "DIRECT_SHUFFLE_PARTITION_ID" in plan.upper()
    many = spark.range(1, 13001).selectExpr("7L as image_id", "id as idx", "id * 1.0e0 as x", "0.0e0 as y")
    with pytest.raises(Exception, match="more than a text can hold"):
        annotations.coords_csv_rows(shapes, many).collect()


def test_csv_query_sorts_no_pairs(spark, small):
    from lamella.plans.registry import QUERIES

    plan = QUERIES["coords_csv_write"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "fiducial_" in plan and "range#" not in plan and "collect_list(e#" not in plan
