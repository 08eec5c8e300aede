"""Connected components of an edge table by alternating star contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .shared import split_join, written

#: Edges that one task joins without effort, though they all be of one hub.
FEW_EDGES = 200_000


def connected_components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(id, component) for each id of ``edges(a, b)``; component is the smallest id reachable.

    Large-star and small-star rounds (Kiveris et al., 2014): each is a minimum per
    node and a join back to the edges, in which the edges of a hub are split, so no
    neighbourhood is ever gathered in one task.  Rounds end when the edge set no longer changes; each is written to the
    shared folder.
    """

    def kept(df: DataFrame) -> tuple[DataFrame, tuple[int, object]]:
        """The edges as a table, their number and the sum of their fingerprints."""
        seen = Observation()
        mark = F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
        table = written(df.observe(seen, F.count(F.lit(1)).alias("n"), mark.alias("mark")), "edges")
        return table, (seen.get["n"], seen.get["mark"])

    def both(df: DataFrame) -> DataFrame:
        return df.select("a", "b").union(df.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(df: DataFrame, large: bool, total: int) -> DataFrame:
        # large: each u links its larger neighbours to its least one; small: its smaller ones and itself
        near = both(df) if large else df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = near.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("__n")).select("a", F.least("a", "m").alias("m"), "__n")
        moved = split_join(near, least, ["a"], 2 * total, ["b"]) if total > FEW_EDGES else near.join(least.drop("__n"), "a")
        if large:
            out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    now, was = kept(edges.select("a", "b").where("a <> b").distinct())
    for _ in range(most_rounds if was[0] else 0):
        now, mark = kept(star(star(now, True, was[0]), False, was[0]))
        if mark == was:
            break
        was = mark
    else:
        if was[0]:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    return roots.union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
