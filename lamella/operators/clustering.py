"""Density clustering of areas per image; no task holds a whole image.

An image's sorted areas are cut into pieces of equal length.  What crosses a border are the areas next to
it, the nearest core on either side, and the name of the cluster that goes on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegralType

from ..functions.lineage import cut
from . import sweeps
from .ranks import running

#: Areas of one image that one task sorts.
PIECE = 1 << 18
#: Rows, repeated by eps, that one task sorts: several sorts of them are held at a time, of some KB a row together.
TASK_ROWS = 1 << 18
#: Stands for the name of a cluster that began in an earlier piece.
EARLIER = float("-inf")
FIRST = Window.unboundedPreceding


def pieces(masks: DataFrame, most: int, piece: int = PIECE) -> DataFrame:
    """(image_id, idx, area, rank, piece, near) for masks(image_id, idx, area), written.

    near: ascending distances to the ``most`` nearest areas, itself included.  They lie within most - 1
    ranks, so a piece needs that many rows of its neighbours.  A row is a core of (eps, k) if near[k - 1] <= eps.
    """
    reach, size = most - 1, max(piece, most)
    rows = running(masks.select("image_id", "idx", "area"), ["area", "idx"]).select("image_id", "idx", "area", F.col("before").alias("rank"))
    home, off = F.floor(F.col("rank") / size), F.col("rank") % size
    copies = F.array_compact(F.array(home, F.when((off < reach) & (home > 0), home - 1), F.when(off >= size - reach, home + 1)))
    around = F.collect_list("area").over(Window.partitionBy("image_id", "piece").orderBy("rank").rowsBetween(-reach, reach))
    rows = rows.withColumn("home", home).withColumn("piece", F.explode(copies)).withColumn("around", around).where("home = piece")
    near = F.slice(F.sort_array(F.transform("around", lambda v: F.abs(v - F.col("area")))), 1, most)
    return cut(rows.select("image_id", "idx", "area", "rank", "piece", near.alias("near")))


def assigned(base: DataFrame, per: DataFrame, min_samples: list[int | Column]) -> DataFrame:
    """(image_id, piece, idx, area, trials) for the pieces of ``base`` and every step of per(image_id, eps: array).

    trials: per min_samples a struct of trial (steps outer), eps, core, run and other.  run is the least core area of the
    row's cluster, or EARLIER; null for noise.  other is the cluster above that a border row reaches as well.  Images that
    per lacks are left out.  Rows are repeated by eps only: all min_samples are columns of the same window passes.
    """
    keys, area, eps, k = ["image_id", "piece", "step"], F.col("area"), F.col("eps"), range(len(min_samples))
    steps = base.select("image_id", "piece").distinct().join(per.select("image_id", F.posexplode("eps").alias("step", "eps"), *[c for c in per.columns if c not in ("image_id", "eps")]), "image_id")
    # the number of parts follows the rows times the steps, which the size of what is exchanged does not show
    most = per.agg(F.max(F.size("eps"))).first()[0] or 1
    parts = max(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-base.count() * most // TASK_ROWS))
    rows = base.repartition(parts, "image_id", "piece").join(steps, ["image_id", "piece"])
    least = [F.get("near", (m if isinstance(m, Column) else F.lit(m)) - 1) for m in min_samples]
    rows = rows.withColumn("core", F.array(*[F.coalesce(v <= eps, F.lit(False)) for v in least]))
    col = lambda name, j: F.get(name, F.lit(j))
    cores = [F.when(col("core", j), area) for j in k]
    ends = rows.groupBy(*keys).agg(F.array(*[F.max(c) for c in cores]).alias("hi"), F.array(*[F.min(c) for c in cores]).alias("lo"))
    image = Window.partitionBy("image_id", "step")
    earlier, later = image.orderBy("piece").rowsBetween(FIRST, -1), image.orderBy(F.desc("piece")).rowsBetween(FIRST, -1)
    ends = ends.select(*keys, F.array(*[F.max(col("hi", j)).over(earlier) for j in k]).alias("under"), F.array(*[F.min(col("lo", j)).over(later) for j in k]).alias("over"))
    here = Window.partitionBy(*keys)
    up, down = here.orderBy("rank"), here.orderBy(F.desc("rank")).rowsBetween(FIRST, 0)
    rows = rows.repartition(parts, *keys).join(ends, keys).withColumn("next", F.array(*[F.coalesce(F.min(cores[j]).over(down), col("over", j)) for j in k]))
    rows = rows.withColumn("prev", F.array(*[F.coalesce(F.max(cores[j]).over(up.rowsBetween(FIRST, -1)), col("under", j)) for j in k]))
    starts = [F.when(col("prev", j).isNull() | (area - col("prev", j) > eps), cores[j]) for j in k]
    rows = rows.withColumn("began", F.array(*[F.coalesce(F.max(starts[j]).over(up.rowsBetween(FIRST, 0)), F.lit(EARLIER)) for j in k]))

    def trial(j: int) -> Column:
        core, prev, after = col("core", j), col("prev", j), col("next", j)
        below, above = area - prev <= eps, after - area <= eps
        run = F.when(core | below, col("began", j)).when(above, after)
        other = F.when(~core & below & above & (after - prev > eps), after)
        return F.struct((F.col("step") * len(min_samples) + j).alias("trial"), eps.alias("eps"), core.alias("core"), run.alias("run"), other.alias("other"))

    return rows.select("image_id", "piece", "idx", "area", F.array(*[trial(j) for j in k]).alias("trials"))


def named(parts: DataFrame) -> DataFrame:
    """parts(image_id, trial, piece, run, top, ..) with name: the run, or where it is EARLIER the last cluster that
    began in an earlier piece (top: the last one that began in this piece)."""
    keys = ["image_id", "trial", "piece"]
    before = Window.partitionBy("image_id", "trial").orderBy("piece").rowsBetween(FIRST, -1)
    tops = parts.groupBy(*keys).agg(F.max("top").alias("__top")).select(*keys, F.max("__top").over(before).alias("__last"))
    return parts.join(tops, keys).withColumn("name", F.when(F.col("run") == EARLIER, F.col("__last")).otherwise(F.col("run"))).drop("__last", "top")


def _parted(base: DataFrame, work: Callable[[DataFrame], DataFrame], whole: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work over the images of several pieces, and whole over those of one, which need no borders."""
    if not isinstance(base.schema["idx"].dataType, IntegralType) or not isinstance(base.schema["area"].dataType, DoubleType):
        return work(base)
    wide = cut(base.where("piece > 0").select("image_id").distinct())
    if wide.isEmpty():
        return whole(base)
    return whole(base.join(wide, "image_id", "left_anti")).unionByName(work(base.join(wide, "image_id", "left_semi")))


def _top() -> Column:
    return F.max(F.when(F.col("core") & (F.col("run") > EARLIER), F.col("run"))).alias("top")


def clusters(base: DataFrame, per: DataFrame, min_samples: int | Column, ranked: bool = False) -> DataFrame:
    """(image_id, idx, area, found[, label]) under one eps per image; found is the cluster's least core index.

    A border row goes to the reachable cluster of smaller found.  label (if ranked) counts an image's clusters by found; noise has
    found null and label -1.
    """
    out = _parted(base, lambda b: _wide_clusters(b, per, min_samples, ranked), lambda b: sweeps.clusters(b, per, min_samples))
    return out if ranked else out.drop("label")


def _wide_clusters(base: DataFrame, per: DataFrame, min_samples: int | Column, ranked: bool) -> DataFrame:
    t = F.col("trials")[0]
    rows = cut(assigned(base, per, [min_samples]).select("image_id", "piece", "idx", "area", t["core"].alias("core"), t["run"].alias("run"), t["other"].alias("other")))
    parts = rows.where("run is not null").withColumn("trial", F.lit(0)).groupBy("image_id", "trial", "piece", "run").agg(_top(), F.min(F.when(F.col("core"), F.col("idx"))).alias("f"), F.max("other").alias("other"))
    parts = cut(named(parts))
    founds = parts.groupBy("image_id", "name").agg(F.min("f").alias("found"))
    if ranked:
        founds = running(founds.where("found is not null"), ["found"]).select("image_id", "name", "found", F.col("before").alias("label"))
    else:
        founds = founds.withColumn("label", F.lit(None).cast("long"))
    other = founds.select("image_id", F.col("name").alias("other"), F.struct("found", "label").alias("b"))
    table = parts.join(founds, ["image_id", "name"]).join(other, ["image_id", "other"], "left")
    a = F.struct("found", "label")
    table = table.select("image_id", "piece", "run", a.alias("a"), F.least(a, "b").alias("b"))
    own = F.when(F.col("other").isNotNull(), F.col("b")).otherwise(F.col("a"))
    out = rows.join(table, ["image_id", "piece", "run"], "left").select("image_id", "idx", "area", own.alias("c"))
    return out.select("image_id", "idx", "area", "c.found", F.coalesce("c.label", F.lit(-1).cast("long")).alias("label"))


def area_dbscan(masks: DataFrame, eps: float, min_samples: int, piece: int = PIECE) -> DataFrame:
    """(image_id, idx, area, label) for masks(image_id, idx, area), idx unique in its image.

    Labels count clusters by their least core index, border rows go to the first reachable one, noise is -1 (null and NaN areas too).
    """
    per = masks.select("image_id").distinct().withColumn("eps", F.array(F.lit(float(eps))))
    return clusters(pieces(masks, min_samples, piece), per, min_samples, ranked=True).select("image_id", "idx", "area", "label")


def largest(base: DataFrame, per: DataFrame, min_samples: list[int]) -> DataFrame:
    """Each image's and trial's largest cluster (image_id, trial, found, eps, n, x, y); of equal ones the one found first.

    x and y are xors of two fingerprints of the members' indices, so equal sets are told without lists.
    """
    return _parted(base, lambda b: _wide_largest(b, per, min_samples), lambda b: sweeps.largest(b, per, min_samples))


def _wide_largest(base: DataFrame, per: DataFrame, min_samples: list[int]) -> DataFrame:
    rows = assigned(base, per, min_samples).select("image_id", "piece", F.xxhash64("idx").alias("x"), F.xxhash64("idx", F.lit(1)).alias("y"), "idx", F.explode("trials").alias("t"))
    rows = rows.select("image_id", "piece", "idx", "x", "y", "t.*").where("run is not null")
    sure, open_ = F.col("other").isNull(), F.col("other").isNotNull()
    xor = lambda c, cond: F.coalesce(F.bit_xor(F.when(cond, F.col(c))), F.lit(0).cast("long"))
    parts = rows.groupBy("image_id", "trial", "piece", "run").agg(
        _top(), F.min("eps").alias("eps"), F.min(F.when(F.col("core"), F.col("idx"))).alias("found"), F.max("other").alias("other"),
        F.count_if(sure).alias("n"), xor("x", sure).alias("x"), xor("y", sure).alias("y"), F.count_if(open_).alias("n2"), xor("x", open_).alias("x2"), xor("y", open_).alias("y2"),
    )
    keys = ["image_id", "trial", "name"]
    least = [F.min(c).alias(c) for c in ("eps", "found", "other")]
    whole = cut(named(parts).groupBy(*keys).agg(*least, *[(F.sum if c[0] == "n" else F.bit_xor)(c).alias(c) for c in ("n", "x", "y", "n2", "x2", "y2")]))
    # rows that reach two clusters go, all together, to the one found first
    above = whole.select("image_id", "trial", F.col("name").alias("other"), F.col("found").alias("found2"))
    rest = whole.join(above, ["image_id", "trial", "other"], "left").withColumn("up", F.coalesce(F.col("found2") < F.col("found"), F.lit(False)))
    gain = lambda c: F.when(F.col("up"), F.col(c)).otherwise(F.lit(0).cast("long"))
    keep = lambda c: F.when(F.col("up"), F.lit(0).cast("long")).otherwise(F.col(c))
    none = F.lit(None).cast("long")
    mine = F.struct("name", "found", (F.col("n") + keep("n2")).alias("n"), *[F.col(c).bitwiseXOR(keep(c + "2")).alias(c) for c in "xy"])
    theirs = F.struct(F.col("other").alias("name"), none.alias("found"), gain("n2").alias("n"), *[gain(c + "2").alias(c) for c in "xy"])
    shares = rest.select("image_id", "trial", "eps", F.explode(F.array_compact(F.array(mine, F.when(F.col("up"), theirs)))).alias("s")).select("image_id", "trial", "eps", "s.*")
    sets = shares.groupBy(*keys).agg(F.min("eps").alias("eps"), F.min("found").alias("found"), F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    return sets.groupBy("image_id", "trial").agg(F.max_by(F.struct("found", "eps", "n", "x", "y"), F.struct("n", -F.col("found"))).alias("c")).select("image_id", "trial", "c.*")


def consensus(masks: DataFrame, per: DataFrame, min_samples: list[int], piece: int = PIECE) -> DataFrame:
    """The members (image_id, idx, eps, min_samples) of each image's most frequent largest cluster.

    per(image_id, eps): arrays of values, each tried with every min_samples, eps outer; images that it lacks are left out.
    """
    base = pieces(masks, max(min_samples), piece)
    votes = largest(base, per, min_samples).groupBy("image_id", "n", "x", "y").agg(F.count("*").alias("votes"), F.min_by(F.struct("trial", "found", "eps"), "trial").alias("first"))
    won = votes.groupBy("image_id").agg(F.max_by("first", F.struct("votes", -F.col("first.trial"))).alias("w"))
    tried = F.get(F.array(*[F.lit(m) for m in min_samples]), F.col("w.trial") % len(min_samples))
    won = cut(won.select("image_id", F.array("w.eps").alias("eps"), tried.alias("ms"), F.col("w.found").alias("wanted")))
    # the winner alone is labelled again, which is cheaper than keeping every trial's members
    members = clusters(base, won.select("image_id", "eps", "ms"), F.col("ms")).select("image_id", "idx", "found")
    picked = won.select("image_id", F.col("wanted").alias("found"), F.col("eps")[0].alias("eps"), F.col("ms").alias("min_samples"))
    return members.join(picked, ["image_id", "found"]).select("image_id", "idx", "eps", "min_samples")


def area_sweep_consensus(masks: DataFrame, eps: list[float], min_samples: list[int], piece: int = PIECE) -> DataFrame:
    """``consensus`` over one fixed list of eps."""
    per = masks.select("image_id").distinct().withColumn("eps", F.array(*[F.lit(float(e)) for e in eps]))
    return consensus(masks, per, min_samples, piece)


def finalize_sections(masks: DataFrame, n_eps: int = 12, min_samples: tuple[int, ...] = (2, 3, 4), sweep: bool = True, least: int = 3, piece: int = PIECE) -> DataFrame:
    """What is kept of the masks(image_id, idx, area) that are in their band.

    Images with at least ``least`` masks keep the consensus cluster over eps from max(1, least
    area) to largest area + 1 (none if there is no cluster); others keep the band.
    """
    if not sweep:
        return masks
    span = masks.groupBy("image_id").agg(F.count("*").alias("n"), F.greatest(F.lit(1.0), F.min("area")).alias("lo"), (F.max("area") + 1).alias("hi"))
    steps = F.transform(F.sequence(F.lit(0), F.lit(n_eps - 1)), lambda s: F.col("lo") + s * (F.col("hi") - F.col("lo")) / (n_eps - 1))
    many, few = span.where(F.col("n") >= least), span.where(F.col("n") < least).select("image_id")
    kept = consensus(masks, many.select("image_id", steps.alias("eps")), list(min_samples), piece).select("image_id", "idx")
    return masks.join(kept, ["image_id", "idx"], "left_semi").unionByName(masks.join(few, "image_id", "left_semi")).select(*masks.columns)


def cluster_profile(masks: DataFrame, chosen: DataFrame, bins: int = 10, top: float = 50000.0, piece: int = PIECE) -> DataFrame:
    """Per cluster of the chosen parameters(image_id, eps, min_samples): count, least, largest and mean area,
    whether it is the main one, and the histogram bin of its mean."""
    chosen = cut(chosen.select("image_id", F.array("eps").alias("eps"), F.col("min_samples").alias("ms")))
    most = chosen.agg(F.max("ms")).first()[0] or 1
    rows = clusters(pieces(masks, int(most), piece), chosen, F.col("ms"), ranked=True)
    out = cut(rows.groupBy("image_id", "label").agg(F.count("*").alias("n"), F.min("area").alias("least"), F.max("area").alias("largest"), F.avg("area").alias("mean")))
    main = out.where("label >= 0").groupBy("image_id").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("main"))
    out = out.join(main, "image_id", "left").withColumn("is_main", F.coalesce(F.col("label") == F.col("main"), F.lit(False))).drop("main")
    return out.withColumn("bin", F.width_bucket("mean", F.lit(0.0), F.lit(top), F.lit(bins)).cast("long"))
