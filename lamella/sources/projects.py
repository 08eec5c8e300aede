"""Project documents, manifests and session restore."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import polygons as poly
from .named_files import write_named

LAYERS = ("sections", "fiducials", "raw_sections", "calibration_examples")
DOCUMENT = "image string, sections array<array<array<double>>>, fiducials array<array<double>>, raw_sections array<array<array<double>>>, calibration_examples array<array<array<double>>>"
#: Image extensions that are taken in.
EXTENSIONS = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "czi")


def image_manifest(files: DataFrame) -> DataFrame:
    """(path, image_id, ext, is_slide, export_tag) of files(path, size, mtime) with a known extension."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    return files.where(ext.isin(*EXTENSIONS)).select("path", stem.alias("image_id"), ext.alias("ext"), F.lower("path").endswith(".czi").alias("is_slide"), F.substring(F.sha1("path"), 1, 8).alias("export_tag"), "size", "mtime")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """files(path, size, mtime) below a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return found.select("path", F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"))


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """documents(image_id, json) from a folder of project files; image_id is the stem without the suffix."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("f"), F.col("value").alias("json"))
    return files.select(F.regexp_replace("f", r"(_stim_project)?\.json$", "").alias("image_id"), "json")


def project_read(documents: DataFrame) -> DataFrame:
    """(image_id, layer, idx, polygon) of documents(image_id, json); a missing key is an empty layer, a
    malformed document gives no row, a fiducial is a polygon of one point."""
    parsed = documents.select("image_id", F.from_json("json", DOCUMENT).alias("d"))
    xy = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    out = None
    for layer in LAYERS:
        shapes = F.transform(f"d.{layer}", lambda p: F.array(xy(p)) if layer == "fiducials" else F.transform(p, xy))
        rows = parsed.select("image_id", F.lit(layer).alias("layer"), F.posexplode(shapes).alias("idx", "polygon"))
        out = rows if out is None else out.union(rows)
    return out.withColumn("idx", F.col("idx").cast("long"))


def project_write(rows: DataFrame) -> DataFrame:
    """(image_id, json): one document per image of rows(image_id, layer, idx, polygon); polygons under
    three vertices are left out, missing layers are empty lists."""
    usable = rows.where((F.col("layer") == "fiducials") | poly.valid("polygon"))
    xy = lambda v: F.array(v["x"], v["y"])

    def layer(name: str):  # noqa: ANN202
        items = F.sort_array(F.collect_list(F.when(F.col("layer") == name, F.struct("idx", "polygon"))))
        return F.transform(items, lambda e: xy(F.element_at(e["polygon"], 1)) if name == "fiducials" else F.transform(e["polygon"], xy)).alias(name)

    packed = usable.groupBy("image_id").agg(*[layer(n) for n in LAYERS])
    return packed.select("image_id", F.to_json(F.struct(F.col("image_id").cast("string").alias("image"), *LAYERS)).alias("json"))


def write_projects(documents: DataFrame, path: str) -> None:
    """A project file ``<image_id>_stim_project.json`` for each of documents(image_id, json), all or none."""
    write_named(documents, "image_id", "json", path, "_stim_project.json")


def session_restore(images: DataFrame, projects: DataFrame, annotations: DataFrame, legacy: DataFrame) -> DataFrame:
    """Per image the rows(image_id, kind, idx, polygon) of the first source that qualifies: a project with
    sections, else annotations of a slide with geometry (sections or fiducials), else legacy rows with sections.

    images(image_id, is_slide, has_geometry).
    """
    tagged = projects.withColumn("priority", F.lit(1)).unionByName(
        annotations.join(images.where("is_slide and has_geometry").select("image_id"), "image_id", "left_semi").withColumn("priority", F.lit(2))
    ).unionByName(legacy.withColumn("priority", F.lit(3)))
    fits = tagged.groupBy("image_id", "priority").agg(F.max((F.col("kind") == "section") | (F.col("priority") == 2)).alias("ok")).where("ok")
    first = fits.groupBy("image_id").agg(F.min("priority").alias("priority"))
    return tagged.join(first, ["image_id", "priority"])
