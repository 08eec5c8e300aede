"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are dealt into partitions by the size of their shingle set: partition u holds
sizes over u/2 up to u.  A long document is searched per partition in windows of 2u
shingles that start every u, so a copied item lies whole in one window of comparable
size and its Jaccard similarity with that window is bounded from below (containment c
gives at least c / (2 u / q + 1 - c), 0.18 for c = 0.75 and q = u / 2; 0.33 for q = u).  Each of
``hashes`` minhash values of a window is looked up among the items' own; at 0.18 a
true pair is missed with a probability of 2e-6 (64 hashes).  Candidates are then
verified by exact containment of the item's shingles in the whole document.

Items of fewer words than a shingle have one sequence, the whole item, which is looked
up among all sequences of that length.

The items go to the executors in blocks of bounded size; each block is a pass over
the documents, so a larger benchmark takes more passes, not more memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbits as tb
from .shared import written

HITS = "id long, item_id long, n_shared long, n_item long, short_item boolean"
_rng = np.random.RandomState(5)
_FACTOR = _rng.randint(1, 1 << 62, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _rng.randint(1, 1 << 62, 256, dtype=np.int64).astype(np.uint64)


class ItemBlock:
    """Shingle sets of some items, by size partition, with a sorted list of their minhash values."""

    def __init__(self, ids: list[int | None], texts: list[str], shingle: int, hashes: int):
        buf, offs = tb.text_buffer(pa.array(texts, pa.string()))
        values, first = tb.word_hashes(buf, offs, lower=True)
        at, to = tb.starts_of(first, shingle)  # items under `shingle` words have none
        sets, to = tb.distinct(tb.gram_hashes(values, shingle)[at], to)
        self.ids, self.sets, self.first, self.hashes = ids, sets, to, hashes
        # items under `shingle` words, by length: fingerprints of the whole item, ascending, and the items
        count = np.diff(first)
        self.short: list[tuple[int, np.ndarray, np.ndarray]] = []
        for n in range(1, shingle):
            mine = np.flatnonzero(count == n)
            if len(mine):
                whole = tb.gram_hashes(values, n)[first[mine]]
                order = np.argsort(whole)
                self.short.append((n, whole[order], mine[order]))
        size = np.diff(to)
        some = np.flatnonzero(size)
        self.parts: list[tuple[int, list[tuple[np.ndarray, np.ndarray]]]] = []
        if not len(some):
            return
        least = [np.minimum.reduceat(sets * _FACTOR[k] + _SHIFT[k], to[:-1][some]) for k in range(hashes)]
        size, u = size[some], 4
        while u == 4 or (size > u / 2).any():
            mine = np.flatnonzero((size > (u / 2 if u > 4 else 0)) & (size <= u))
            if len(mine):
                order = [mine[np.argsort(x[mine])] for x in least]
                self.parts.append((u, [(x[o], some[o]) for x, o in zip(least, order, strict=True)]))
            u *= 2


def search(shingles: np.ndarray, first: np.ndarray, block: ItemBlock) -> list[tuple[int, int]]:
    """Candidate (text, item) numbers: some window of the text shares a minhash value with the item."""
    out = set()
    count = np.diff(first)
    plans = []
    for u, keys in block.parts:
        # parts of u shingles; the least of a window is the least of two parts that follow each other
        n_parts = -(-count // u)
        owner = np.repeat(np.arange(len(count)), n_parts)
        start = np.repeat(first[:-1], n_parts) + tb.ranges(np.zeros(len(count), np.int64), n_parts) * u
        if len(start):
            plans.append((keys, owner, start, np.append(owner[1:] == owner[:-1], False)))
    for k in range(block.hashes if plans else 0):
        hashed = shingles * _FACTOR[k]
        hashed += _SHIFT[k]
        for keys, owner, start, pair in plans:
            values, items = keys[k]
            least = np.minimum.reduceat(hashed, start)
            window = np.where(pair, np.minimum(least, np.append(least[1:], least[-1:])), least)
            lo = np.searchsorted(values, window)
            hit = np.flatnonzero(values[np.minimum(lo, len(values) - 1)] == window)
            for w, a, z in zip(hit.tolist(), lo[hit].tolist(), np.searchsorted(values, window[hit], "right").tolist(), strict=True):
                out.update((int(owner[w]), int(i)) for i in items[a:z])
    return sorted(out)


def search_short(values: np.ndarray, first: np.ndarray, block: ItemBlock) -> list[tuple[int, int]]:
    """(text, item) numbers of items under a shingle's length that stand in a text as a whole."""
    out = set()
    for n, whole, items in block.short:
        at, to = tb.starts_of(first, n)
        grams = tb.gram_hashes(values, n)[at]
        lo = np.searchsorted(whole, grams)
        hit = np.flatnonzero(whole[np.minimum(lo, len(whole) - 1)] == grams)
        text = np.searchsorted(to, hit, "right") - 1
        for d, a, z in zip(text.tolist(), lo[hit].tolist(), np.searchsorted(whole, grams[hit], "right").tolist(), strict=True):
            out.update((d, int(i)) for i in items[a:z])
    return sorted(out)


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", containment: int = 75, shingle: int = 5, hashes: int = 64, block_items: int = 20_000) -> DataFrame:
    """Returns ``doc_id, item_id, n_shared, n_item, short_item`` for each document and item of whose
    distinct shingles at least ``containment`` % are in the document.

    A-Z are lower-cased, words are runs of other than ASCII white space.  An item of fewer
    than ``shingle`` words has one sequence, the whole item (n_item 1); since a few words say
    little, short_item marks these results, and a caller decides what follows from them.

    Cases: null or empty items and texts, and those without words, match nothing.
    Repeated rows of docs give repeated results; repeated items too.  Null ids on either
    side stay null in the result.  Empty tables give an empty result.  A very long text is
    searched whole.  Other columns of either table are ignored.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    queries = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    n_items = queries.count()
    n_blocks = -(-n_items // block_items)
    out = None
    for b in range(n_blocks):
        rows = queries.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == b).orderBy("item", "text").collect()  # about block_items rows
        held = spark.sparkContext.broadcast(ItemBlock([r["item"] for r in rows], [r["text"] for r in rows], shingle, hashes))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            block = held.value
            for batch in tb.slices(batches):
                values, first = tb.word_hashes(*tb.text_buffer(batch.column("text")), lower=True)
                at, to = tb.starts_of(first, shingle)
                grams = tb.gram_hashes(values, shingle)[at]
                found = [(batch.column("id")[d].as_py(), block.ids[i], 1, 1, True) for d, i in search_short(values, first, block)]
                own, last = np.zeros(0, np.uint64), -1
                for d, i in search(grams, to, block):
                    if d != last:
                        own, last = np.unique(grams[to[d] : to[d + 1]]), d
                    wanted = block.sets[block.first[i] : block.first[i + 1]]
                    place = np.searchsorted(own, wanted)
                    place[place == len(own)] = 0
                    shared = int((own[place] == wanted).sum())
                    if 100 * shared >= containment * len(wanted):
                        found.append((batch.column("id")[d].as_py(), block.ids[i], shared, len(wanted), False))
                if found:
                    kinds = [pa.int64()] * 4 + [pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), kinds, strict=True)], names=["id", "item_id", "n_shared", "n_item", "short_item"])

        hits = plain.mapInArrow(run, HITS)
        out = hits if out is None else out.union(hits)
    if out is None:
        out = spark.createDataFrame([], HITS)
    return written(out, "leaks").withColumnRenamed("id", id_col)
