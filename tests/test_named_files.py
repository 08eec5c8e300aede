"""One named file per row, all of them or none."""

import os

import pytest
from pyspark.sql import functions as F

from lamella.functions import polygons as poly
from lamella.plans.fixtures import Fixtures
from lamella.sources import annotations, projects
from lamella.sources.named_files import file_name, write_named


def files(path):
    return sorted(os.path.join(d, f)[len(str(path)) + 1 :] for d, _, found in os.walk(path) for f in found)


def test_a_file_per_image_that_is_read_again(spark, small, tmp_path):
    shapes = Fixtures(spark, small).sections.where(poly.valid("polygon"))
    documents = projects.project_write(shapes.select("image_id", F.lit("sections").alias("layer"), F.col("mask_id").alias("idx"), "polygon"))
    projects.write_projects(documents, str(tmp_path))
    want = {str(r.image_id): r.json for r in documents.collect()}
    assert {f for f in files(tmp_path) if not f.endswith(".crc")} == {f"{i}_stim_project.json" for i in want}
    assert {r.image_id: r.json for r in projects.read_projects(spark, str(tmp_path)).collect()} == want
    projects.write_projects(documents, str(tmp_path))  # a second time replaces them
    assert len(files(tmp_path)) == len(want)
    features = spark.createDataFrame([(i, f"section_{k}", "section", '{"k":%d}' % k) for i in (1, 2) for k in (2, 1)], "image_id long, id string, type string, feature string")
    annotations.write_features(annotations.feature_collections(features), str(tmp_path / "geo"))
    assert files(tmp_path / "geo") == ["1.geojson", "2.geojson"]


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").alias("name"), F.when(F.col("id") == 33, F.raise_error(F.lit("broken"))).otherwise("x").alias("text"))
    with pytest.raises(Exception):  # noqa: B017, PT011
        write_named(rows, "name", "text", str(tmp_path), ".json")
    assert files(tmp_path) == [] and os.listdir(tmp_path) == []


@pytest.mark.parametrize("rows", [[("a", "1"), ("a", "2")], [(None, "1"), ("b", "2")], [("", "1")]])
def test_equal_and_missing_names_fail(spark, tmp_path, rows):
    with pytest.raises(Exception):  # noqa: B017, PT011
        write_named(spark.createDataFrame(rows, "name string, text string"), "name", "text", str(tmp_path), "")
    assert files(tmp_path) == []


def test_odd_names_null_text_and_empty_tables(spark, tmp_path):
    rows = [("../up", "1"), (".hidden", None), ("_x", "3"), ("a b/c", "ü"), ("50%", "5")]
    write_named(spark.createDataFrame(rows, "name string, text string"), "name", "text", str(tmp_path), ".t")
    assert files(tmp_path) == sorted(file_name(n, ".t") for n, _ in rows)
    assert (tmp_path / file_name("a b/c", ".t")).read_text() == "ü" and (tmp_path / file_name(".hidden", ".t")).read_text() == ""
    write_named(spark.createDataFrame([], "name string, text string"), "name", "text", str(tmp_path), ".t")
    assert len(files(tmp_path)) == 5
