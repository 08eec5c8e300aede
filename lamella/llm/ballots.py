"""Fingerprint ballots: asking all of a corpus about many fingerprints at little cost.

Rows of documents are dealt into groups.  A group sends its fingerprints, packed as
one binary *ballot* per bucket of the fingerprint space; a bucket sees all ballots
about its own fingerprints and answers each with a few bits per fingerprint, in the
order of the ballot; the answers return to the group.

Scale.  A group sends each fingerprint once, however often it holds it, so the most
frequent one costs a bucket one entry per group.  Buckets are even because fingerprints
are.  The numbers of groups and buckets follow the bytes of text, which bounds both and
the size of a ballot (``dealing``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbits as tb
from .shared import tasks

BALLOT = "bucket int, g int, blob binary"
ANSWER = "g int, bucket int, blob binary"
#: Bytes of text per group, and of the corpus per bucket, that fit a task's memory.
GROUP_BYTES = 32 << 20
BUCKET_BYTES = 1 << 30
#: Below these no more groups or buckets are made, however many tasks there could be.
LEAST_GROUP_BYTES = 1 << 20
LEAST_BUCKET_BYTES = 3 << 20
#: Bytes of a group's text for each bucket, so that a ballot holds some dozens of fingerprints.
BALLOT_BYTES = 1 << 11


def dealing(size: int, least: int) -> tuple[int, int]:
    """Numbers of groups and buckets for ``size`` bytes of text where ``least`` tasks could run at once.

    Ballots number groups times buckets, so neither follows the tasks alone; where there
    are many buckets the groups are larger (200 MB at 100 TB), and the ballots stay of a size."""
    buckets = max(1, -(-size // BUCKET_BYTES), min(least, size // LEAST_BUCKET_BYTES))
    groups = max(1, -(-size // max(GROUP_BYTES, BALLOT_BYTES * buckets)), min(4 * least, size // LEAST_GROUP_BYTES))
    return groups, buckets


def grouped(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """(g, id, text, c0, c1, ..) and the number of buckets: documents dealt into groups by a
    hash of their id and text, so that an id of many texts is spread, with the columns ``carry`` beside them."""
    text = F.col(text_col).cast("string")
    size = docs.agg(F.sum(F.octet_length(text)).alias("s")).first()["s"] or 0
    n, n_buckets = dealing(size, tasks(docs.sparkSession))
    of = F.pmod(F.xxhash64("id", "text"), F.lit(n))
    beside = [F.col(c).alias(f"c{k}") for k, c in enumerate(carry)]
    plain = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), *beside)
    return plain.select(of.cast("int").alias("g"), "id", "text", *[f"c{k}" for k in range(len(carry))]), n_buckets


class Group:
    """The texts of one group in (id, text) order."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        self.rows = rows = rows.take(pc.sort_indices(rows, sort_keys=[("id", "ascending"), ("text", "ascending")]))
        self.g = rows.column("g")[0].as_py()
        self.id_column = rows.column("id").combine_chunks()
        self.ids = np.asarray(pc.fill_null(self.id_column, np.iinfo(np.int64).max))
        self.buf, self.offs = tb.text_buffer(rows.column("text"))


def text_runs(offs: np.ndarray) -> list[tuple[int, int]]:
    """Runs of whole texts [i, j) of about ``SLICE_BYTES``; a longer text is a run alone."""
    out, at = [], 0
    while at < len(offs) - 1:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + tb.SLICE_BYTES, "right")) - 1)
        out.append((at, to))
        at = to
    return out


def sent(g: int, buckets: dict[int, bytes]) -> pa.Table:
    return pa.table({"bucket": pa.array(list(buckets), pa.int32()), "g": pa.array([g] * len(buckets), pa.int32()), "blob": pa.array(list(buckets.values()), pa.binary())})


def answered(g: list[int], bucket: list[int], blobs: list[bytes]) -> pa.Table:
    return pa.table({"g": pa.array(g, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "blob": pa.array(blobs, pa.binary())})


def deal(hashes: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts fingerprints by bucket (stable), and each bucket's first place."""
    bucket = (hashes % np.uint64(n_buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n_buckets + 1))


def repeated(values: np.ndarray) -> np.ndarray:
    """True where a value stands more than once."""
    out = np.zeros(len(values), bool)
    if len(values) > 1:
        order = np.argsort(values, kind="stable")
        same = values[order][1:] == values[order][:-1]
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
    return out
