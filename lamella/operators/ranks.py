"""Running sums, ranks and exact percentiles of groups that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut


def running(rows: DataFrame, order: list[str | Column], weight: str | None = None, group: str = "image_id") -> DataFrame:
    """Adds before (weights of the group's rows that come earlier) and total (of all its rows).

    Rows are sorted into ranges of (group, order), so a large group lies in many tasks; only one sum per
    group and range is carried on.  Without a weight every row counts 1.  Rows without a group are left out.
    """
    w = F.col(weight) if weight else F.lit(1).cast("long")
    placed = cut(rows.repartitionByRange(group, *order).withColumn("__range", F.spark_partition_id()))
    one, first = Window.partitionBy(group), Window.unboundedPreceding
    sums = placed.groupBy(group, "__range").agg(F.sum(w).alias("__w"))
    sums = sums.select(group, "__range", F.coalesce(F.sum("__w").over(one.orderBy("__range").rowsBetween(first, -1)), F.lit(0)).alias("__ahead"), F.sum("__w").over(one).alias("total"))
    here = Window.partitionBy(group, "__range").orderBy(*order).rowsBetween(first, -1)
    return placed.join(sums, [group, "__range"]).withColumn("before", F.col("__ahead") + F.coalesce(F.sum(w).over(here), F.lit(0))).drop("__range", "__ahead")


def at_share(share: float, value: str, before: str, n: str, total: Column) -> Column:
    """Aggregate: the percentile of a group's distinct values with counts n and running sums before.

    Between two values it is interpolated, as ``percentile`` does; null for groups without values.
    """
    place = F.lit(float(share)) * (total - 1)
    at = lambda k: F.max(F.when((F.col(before) <= k) & (k < F.col(before) + F.col(n)), F.col(value)))
    low, high, part = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
    return F.when(low == high, low.cast("double")).otherwise((1 - part) * low + part * high)


def percentiles(rows: DataFrame, value: str, shares: dict[str, float], group: str = "image_id") -> DataFrame:
    """(group, one column per share): exact percentiles of the values that are not null.

    Equal values are counted before they travel; no aggregation buffer holds a group's distinct values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    ranked = running(counts, [value], "n", group)
    return ranked.groupBy(group).agg(*[at_share(share, value, "before", "n", F.col("total")).alias(name) for name, share in shares.items()])
