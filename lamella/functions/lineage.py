"""Cutting lineage between the rounds of an iterative operator."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def work_folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``.

    Where the setting is absent (one machine, as in tests) a temporary folder is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="spark-")
        _own[spark.sparkContext.applicationId] = base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written to the folder of ``spark.checkpoint.dir`` and read again."""
    spark, path = df.sparkSession, work_folder(df.sparkSession, "round")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


def forget(*done: DataFrame | None) -> None:
    """Removes the files of what ``cut`` returned, once nothing reads them any more."""
    for df in done:
        if df is not None and (path := _written.pop(df, None)):
            top = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            top.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(top, True)


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Within it, what a query has shuffled is removed when it ends, and not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)
