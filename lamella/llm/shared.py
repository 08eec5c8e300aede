"""Work folders in the place that the cluster shares, and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``.  Where that setting is absent (tests
    on one machine) a folder of that machine takes its place."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="spark-")
        _own[spark.sparkContext.applicationId] = base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage, and a
    lost executor costs a reread only."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Rows of one key that a join leaves together, however many tasks there are.
HOT_ROWS = 256
#: Rows of ids and numbers that a single task joins without effort; joins of fewer are plain.
FEW_ROWS = 20_000


def parts_of(n: str | Column, total: int, spark: SparkSession) -> Column:
    """Into how many parts ``n`` of ``total`` rows are split: one for each quarter of a task's even share."""
    share = max(HOT_ROWS, total // (4 * tasks(spark)))
    return F.greatest(F.lit(1), F.ceil((F.col(n) if isinstance(n, str) else n) / share)).cast("int")


def split_join(big: DataFrame, per_key: DataFrame, key: list[str], total: int, by: list[str], how: str = "inner") -> DataFrame:
    """``big`` joined (``inner`` or ``left``) with ``per_key``: one row for each value of ``key``, with the number ``__n`` of its rows in big.

    The rows of a key that has more than its share are dealt by a hash of ``by``, and
    its row in per_key goes to each part.  ``total`` rows, of big or more, can have at
    most four such keys for each task, which bounds the broadcast list of them.
    """
    if total <= FEW_ROWS:
        return big.join(per_key.drop("__n"), key, how)
    sized = per_key.withColumn("__parts", parts_of("__n", total, big.sparkSession))
    hot = F.broadcast(sized.where("__parts > 1").select(*key, "__parts"))
    dealt = big.join(hot, key, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(*by), F.col("__parts")), F.lit(0)).cast("int")).drop("__parts")
    each = sized.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts", "__n")
    return dealt.join(each, [*key, "__salt"], how).drop("__salt")
