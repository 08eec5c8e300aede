"""MinHash near-duplicate detection with tensored banding.

Two small collections of half keys (each joins ``hashes_per_half`` minhashes) are
computed per document.  A table is keyed by one half key of the first and one of
the second collection, so ``halves`` x ``halves`` tables come from 2 x ``halves``
half keys.  A pair meets in some table exactly if it shares a half key in both
collections; at similarity s it is missed with a probability of about
``2 (1 - s**hashes_per_half)**halves`` (1e-4 at 0.75 with the defaults, 3e-9 at 0.9).

Scale.  Documents with equal shingle sets are one class and only classes are
compared.  Half keys that nobody shares are dropped before tables are formed.  In
each table bucket everyone is compared with the bucket's least class (its pivot), not
with everyone.  What a pivot does not settle is compared pairwise only where the
triangle inequality of the Jaccard distance leaves a link possible, so no link is lost.
Links are confirmed on the full shingle sets, streamed per pivot in salted parts.
Joins on what very many documents can share (a half key, a table key, a pivot, a class)
split such a key over several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbits as tb
from .components import connected_components
from .shared import parts_of, split_join, tasks, written

SIGNATURE = "id long, n_shingles long, set_a long, set_b long, half_a array<long>, half_b array<long>"
#: Rows of either side of a block of unsettled pairs.
BLOCK_ROWS = 256


def signatures(docs: DataFrame, shingle: int = 5, halves: int = 12, hashes_per_half: int = 2) -> DataFrame:
    """Set size, set fingerprint and half keys of every text of ``docs(id, text)``."""
    n_hash = 2 * halves * hashes_per_half
    rng = np.random.RandomState(77)
    factor = rng.randint(1, 1 << 62, n_hash, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.randint(1, 1 << 62, n_hash, dtype=np.int64).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches):
            buf, offs = tb.text_buffer(batch.column("text"))
            hashes, first = tb.word_hashes(buf, offs, lower=True)
            sets, to = tb.distinct(*tb.shingles(hashes, first, shingle))
            size = np.diff(to)
            some = np.flatnonzero(size)
            half = np.zeros((len(size), 2 * halves), np.uint64)
            a, b = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
            if len(some):
                at = to[:-1][some]
                a[some] = np.add.reduceat(sets, at)
                b[some] = np.add.reduceat(tb.mix(sets ^ np.uint64(0xA5A5A5A55A5A5A5A)), at)
                for k in range(n_hash):
                    least = np.minimum.reduceat(sets * factor[k] + shift[k], at)
                    j = k // hashes_per_half
                    half[some, j] = tb.mix(half[some, j] * np.uint64(0x9E3779B97F4A7C15) + least + np.uint64(j + 1))
            lists = lambda x: pa.ListArray.from_arrays(np.arange(len(size) + 1, dtype=np.int32) * halves, pa.array(np.ascontiguousarray(x).ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(size), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), lists(half[:, :halves]), lists(half[:, halves:])],
                names=["id", "n_shingles", "set_a", "set_b", "half_a", "half_b"],
            )

    return docs.select("id", "text").mapInArrow(run, SIGNATURE)


def verify(pairs: DataFrame, docs: DataFrame, shingle: int, total: int) -> DataFrame:
    """Exact (x, p, inter, n_x, n_p) of the shingle sets for ``pairs(x, p)``, at most ``total`` of them.

    Rows are dealt by (p, salt); in each run the pivot's text comes first and its set
    stays in memory while the members stream past.  The parts of a pivot are bounded by
    the number of tasks, and so are the copies of its text.  Where an id stands on several
    texts, all of a pivot's sets stay, and each of them meets each of a member's.
    """
    spark = docs.sparkSession
    load = pairs.groupBy("p").agg(F.count("*").alias("__n")).withColumn("parts", parts_of("__n", total, spark))
    members = split_join(pairs, load, ["p"], total, ["x"]).select(F.col("x").alias("id"), "p", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int").alias("salt"), F.lit(1).alias("role"))
    pivots = load.select(F.col("p").alias("id"), "p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("role"))
    asked = members.union(pivots).join(docs.select("id", "text"), "id")
    dealt = asked.repartition(2 * tasks(spark), "p", "salt").sortWithinPartitions("p", "salt", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, held = None, []
        for batch in tb.slices(batches):
            buf, offs = tb.text_buffer(batch.column("text"))
            sets, to = tb.distinct(*tb.shingles(*tb.word_hashes(buf, offs, lower=True), shingle))
            x, p, salt, role = (batch.column(c).to_pylist() for c in ("id", "p", "salt", "role"))
            out = []
            for i in range(len(x)):
                mine = sets[to[i] : to[i + 1]]
                if role[i] == 0:
                    if pivot != (p[i], salt[i]):
                        pivot, held = (p[i], salt[i]), []
                    if not any(np.array_equal(mine, other) for other in held):
                        held.append(mine.copy())
                    continue
                assert pivot == (p[i], salt[i]), "a pivot's row precedes its members"
                for other in held:
                    small, large = (mine, other) if len(mine) <= len(other) else (other, mine)
                    at = np.searchsorted(large, small)
                    at[at == len(large)] = 0
                    out.append((x[i], p[i], int((large[at] == small).sum()) if len(large) else 0, len(mine), len(other)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["x", "p", "inter", "n_x", "n_p"])

    return dealt.select("id", "p", "salt", "role", "text").mapInArrow(run, "x long, p long, inter long, n_x long, n_p long")


def unsettled_links(tested: DataFrame, parts: DataFrame, classes: DataFrame, docs: DataFrame, similarity: int, shingle: int) -> DataFrame:
    """Links (a, b) between classes that met in a pivot's tables but lie in different components.

    Of each pivot's circle only members outside the pivot's component are compared with
    the circle, in blocks of at most ``BLOCK_ROWS`` by ``BLOCK_ROWS``; a pair is looked at if
    its distances to the pivot differ by no more than a link allows, its sizes fit and its
    half keys meet.  Sets are compared in full, and only links leave a block.
    """
    gap = 1 - similarity / 100 + 1e-9
    lab = parts.select(F.col("id").alias("x"), F.col("component").alias("c"))
    own = tested.select("p").distinct().select(F.col("p").alias("x"), "p", F.lit(0.0).alias("d"))
    circle = tested.select("x", "p", (1 - F.col("inter") / (F.col("n_x") + F.col("n_p") - F.col("inter"))).alias("d")).union(own)
    circle = circle.join(lab, "x", "left").withColumn("c", F.coalesce("c", "x"))
    total = 2 * tested.count()
    centre = lab.select(F.col("x").alias("p"), F.col("c").alias("pc"))
    centre = circle.groupBy("p").agg(F.count("*").alias("__n")).join(centre, "p", "left").withColumn("pc", F.coalesce("pc", "p"))
    circle = split_join(circle, centre, ["p"], total, ["x"])
    circle = written(circle.withColumn("outside", F.col("c") != F.col("pc")), "circle")
    load = circle.groupBy("p").agg(F.count_if("outside").alias("r"), F.count("*").alias("__n")).where("r > 0")
    load = load.select("p", F.ceil(F.col("r") / BLOCK_ROWS).cast("int").alias("nr"), F.ceil(F.col("__n") / BLOCK_ROWS).cast("int").alias("nb"), "__n")
    rows = split_join(circle, load, ["p"], total, ["x"]).withColumn("h", F.pmod(F.xxhash64("x"), F.lit(1 << 30)))
    full = written(rows.join(classes.withColumnRenamed("id", "x"), "x").join(docs.select(F.col("id").alias("x"), "text"), "x"), "circles")
    fields = ["p", "rb", "bb", "x", "c", "pc", "d", "half_a", "half_b", "text"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outer = full.where("outside").withColumn("rb", F.pmod("h", "nr").cast("int")).withColumn("bb", every("nb")).select(*fields)
    inner = full.withColumn("bb", F.pmod("h", "nb").cast("int")).withColumn("rb", every("nr")).select(*fields)

    def sets_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return tb.distinct(*tb.shingles(*tb.word_hashes(*tb.text_buffer(table.column("text")), lower=True), shingle))

    def halves_of(table: pa.Table, name: str) -> np.ndarray:
        return np.asarray(table.column(name).combine_chunks().flatten()).reshape(table.num_rows, -1)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            (u, uf), (v, vf) = sets_of(left), sets_of(right)
            x, y, c, e = (np.asarray(t.column(k)) for t, k in ((left, "x"), (right, "x"), (left, "c"), (right, "c")))
            central = e == np.asarray(right.column("pc"))
            d, f = np.asarray(left.column("d")), np.asarray(right.column("d"))
            ua, ub, va, vb = halves_of(left, "half_a"), halves_of(left, "half_b"), halves_of(right, "half_a"), halves_of(right, "half_b")
            n, m = np.diff(uf), np.diff(vf)
            for i in range(left.num_rows):
                ok = (e != c[i]) & (np.abs(f - d[i]) <= gap) & (central | (x[i] < y))
                ok &= 100 * np.minimum(n[i], m) >= similarity * np.maximum(n[i], m)
                ok &= (va == ua[i]).any(axis=1) & (vb == ub[i]).any(axis=1)
                j = np.flatnonzero(ok)
                if not len(j):
                    continue
                mine = u[uf[i] : uf[i + 1]]
                theirs = v[tb.ranges(vf[j], m[j])]
                at = np.searchsorted(mine, theirs)
                at[at == len(mine)] = 0
                inter = tb.segment_sum(mine[at] == theirs, np.concatenate([[0], np.cumsum(m[j])]))
                j = j[100 * inter >= similarity * (n[i] + m[j] - inter)]
                found += [(int(x[i]), int(k)) for k in y[j]]
        return pa.table({"a": pa.array([k[0] for k in found], pa.int64()), "b": pa.array([k[1] for k in found], pa.int64())})

    keys = ["p", "rb", "bb"]
    return outer.groupBy(*keys).cogroup(inner.groupBy(*keys)).applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = 75, shingle: int = 5, halves: int = 12, hashes_per_half: int = 2) -> DataFrame:
    """Returns ``id_col, n_shingles, component_id, kept, class_id, n_links`` for each row of docs.

    Rule: A-Z are lower-cased, words are runs of other than ASCII white space, a set
    holds the distinct ``shingle``-word sequences (with fewer words the whole sequence),
    and texts with 100 * intersection >= similarity * union are linked.
    component_id is the least id reachable; kept says that it is the row's own id.
    class_id is the least id with the same set; n_links counts the confirmed links of that
    class to pivots and unsettled partners (not all pairs of a component).

    Cases: a null, empty or white-space text has n_shingles 0 and no link.  A row with a
    null id is never linked: component_id and class_id are null, kept is true.  Repeated
    rows share one result each.  An empty table gives an empty result.  A very long text is
    compared whole.  Ids are expected to name one text; where an id stands on different
    texts, each keeps its own set, is compared for itself, and what links with any of them is in the
    component that the id belongs to (the pipeline gives such rows keys of their own).  Other columns of docs are ignored,
    whatever their names.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sig = written(signatures(plain, shingle, halves, hashes_per_half), "signatures")
    known = sig.where("id is not null and n_shingles > 0")
    classes = written(
        known.groupBy("set_a", "set_b", "n_shingles").agg(F.min(F.struct("id", "half_a", "half_b")).alias("s"), F.count("*").alias("__n")).select("set_a", "set_b", "n_shingles", "s.*", "__n"), "classes"
    )
    n_classes = classes.count()

    # half keys that at least two classes share
    def shared_halves(name: str) -> DataFrame:
        each = classes.select("id", F.explode(name).alias("h"))
        twice = each.groupBy("h").agg(F.count("*").alias("__n")).where("__n > 1")
        return split_join(each, twice, ["h"], n_classes * halves, ["id"]).groupBy("id").agg(F.collect_list("h").alias(name))  # at most `halves` entries

    met = shared_halves("half_a").join(shared_halves("half_b"), "id")
    cells = written(met.select("id", F.explode("half_a").alias("a"), "half_b").select("id", "a", F.explode("half_b").alias("b")).select("id", F.xxhash64("a", "b").alias("key")), "cells")
    n_cells = cells.count()
    pivot = cells.groupBy("key").agg(F.min("id").alias("p"), F.count("*").alias("__n")).where("__n > 1")
    first = split_join(cells, pivot, ["key"], n_cells, ["id"]).where("id <> p").select(F.col("id").alias("x"), "p").distinct()
    sizes = classes.select("id", "n_shingles", "half_a", "half_b")
    linked = f"100 * inter >= {similarity} * (n_x + n_p - inter)"

    # every table member against its pivot; what differs too much in size cannot be linked, but its distance is needed below
    tested = written(verify(first, plain.join(sizes.select("id"), "id", "left_semi"), shingle, n_cells).where("n_x > 0"), "tested")
    links = tested.where(linked).select(F.col("x").alias("a"), F.col("p").alias("b"))
    parts = written(connected_components(links), "parts")

    late = written(unsettled_links(tested, parts, sizes, plain, similarity, shingle), "late")
    links = links.union(late)
    whole = written(connected_components(links), "whole").withColumnRenamed("id", "rep") if late.take(1) else parts.withColumnRenamed("id", "rep")
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    by_class = classes.select("set_a", "set_b", "n_shingles", F.col("id").alias("rep"), "__n").join(whole, "rep", "left").join(degree, "rep", "left")
    by_class = by_class.select("set_a", "set_b", "n_shingles", "rep", "__n", F.coalesce("component", "rep").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    linkable = split_join(known.select("id", "n_shingles", "set_a", "set_b"), by_class, ["set_a", "set_b", "n_shingles"], sig.count(), ["id"])
    alone = sig.where("id is null or n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component"), F.col("id").alias("rep"), F.lit(0).cast("long").alias("n_links"))
    rows = linkable.select("id", "n_shingles", "component", "rep", "n_links").union(alone)
    return rows.select(
        F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"), F.col("rep").alias("class_id"), "n_links"
    )
