"""Tables that streams keep: rows by key that later batches replace, and the results of runs that end.

Every batch writes folders of its own, named by its epoch, so a batch that is repeated
after a failure replaces what it wrote and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def _folders(spark: SparkSession, path: str, needs: str | None = None) -> list[tuple[int, str]]:
    """(epoch, path) of the folders epoch=.. below path, ascending; with ``needs`` only those that hold this file."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    found = [x.getPath() for x in fs.listStatus(top) if x.getPath().getName().startswith("epoch=")]
    return sorted((int(p.getName()[6:]), p.toString()) for p in found if not needs or fs.exists(jvm.org.apache.hadoop.fs.Path(p, needs)))


def _remove(spark: SparkSession, path: str) -> None:
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    top.getFileSystem(spark._jsc.hadoopConfiguration()).delete(top, True)


def upsert_into(path: str, keys: list[str], order: str | None = None, gone: Column | None = None, every: int = 20) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that puts rows into the table at ``path``: a row replaces the one of the same keys.

    Of rows of one key the one of the latest batch stays, or with ``order`` the one with the largest value of that column.
    A batch writes its rows to changes/epoch=..; ``upserted`` merges them when the table is read.  Every ``every`` batches the
    table is written whole to base/epoch=.., without the rows for which ``gone`` holds, and what it is made of is removed.
    A repeated batch changes nothing.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/changes/epoch={epoch}")
        if (epoch + 1) % every == 0:
            table = upserted(spark, path, batch.schema, keys, order, upto=epoch)
            (table.where(~gone | gone.isNull()) if gone is not None else table).write.mode("overwrite").parquet(f"{path}/base/epoch={epoch}")
            bases = _folders(spark, f"{path}/base", "_SUCCESS")
            for e, folder in bases[:-2]:  # the one before stays for those who are reading it
                _remove(spark, folder)
            for e, folder in _folders(spark, f"{path}/changes"):
                if len(bases) > 1 and e <= bases[-2][0]:
                    _remove(spark, folder)

    return run


def upserted(spark: SparkSession, path: str, schema: StructType, keys: list[str], order: str | None = None, upto: int | None = None) -> DataFrame:
    """The table that ``upsert_into`` keeps at ``path``: the last base and the changes since."""
    bases = [(e, p) for e, p in _folders(spark, f"{path}/base", "_SUCCESS") if upto is None or e < upto]
    since = bases[-1][0] if bases else -1
    changes = [p for e, p in _folders(spark, f"{path}/changes", "_SUCCESS") if e > since and (upto is None or e <= upto)]
    parts = [spark.read.schema(schema).parquet(p).withColumn("__epoch", F.lit(e).cast("long")) for e, p in bases[-1:]]
    if changes:
        both = StructType([*schema.fields, StructField("epoch", LongType())])
        parts.append(spark.read.schema(both).option("basePath", f"{path}/changes").parquet(*changes).withColumnRenamed("epoch", "__epoch"))
    if not parts:
        return spark.createDataFrame([], schema)
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    last = F.struct(*([order] if order else []), "__epoch")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*schema.names), last).alias("__row")).select("__row.*")


def finalize_into(path: str, finalize: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for a stream of ``ended_runs``: the runs that ended in this batch are finalised together, from
    all their rows, into final/epoch=..; rows that came after their run's end go to late/epoch=.. as they are."""

    def run(batch: DataFrame, epoch: int) -> None:
        spark, held = batch.sparkSession, f"{path}/ended/epoch={epoch}"
        batch.write.mode("overwrite").parquet(held)  # the state is read once
        rows = spark.read.schema(batch.schema).parquet(held)
        ended, late = rows.where("not late").drop("late"), rows.where("late").drop("late")
        if ended.take(1):
            finalize(ended).write.mode("overwrite").parquet(f"{path}/final/epoch={epoch}")
        if late.take(1):
            late.write.mode("overwrite").parquet(f"{path}/late/epoch={epoch}")
        _remove(spark, held)

    return run


def read_epochs(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """All rows below path/epoch=.., of batches that were written whole."""
    folders = [p for _, p in _folders(spark, path, "_SUCCESS")]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
