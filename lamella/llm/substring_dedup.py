"""Removal of word windows that occur earlier in the corpus, by recompression.

Words are named by 64-bit fingerprints, which are the same on every machine.  A
round of recompression names maximal runs of one word, then pairs of neighbours
whose left member falls on the left and right member on the right side of a
fingerprint bit; three such rounds give symbols of up to eight words.  What lies
inside two equal windows gets equal symbols, because each symbol depends only on the
words of its *context* (its own words and the neighbours that decided its form).

1. Groups of documents send their distinct top symbols; buckets answer which occur
   in two groups.
2. A window that holds the whole context of a symbol that occurs once cannot repeat.
   Of the other windows each group sends the first of each kind, named by a 128-bit
   cryptographic digest of its words; buckets answer which start earlier (by id).
3. Each group removes the words that such windows cover.

Windows of one name are equal, so names need no verification; a symbol's fingerprint
only rules windows out that hold a symbol which occurs once, and an accident there
(two symbols of one fingerprint) only lets more windows be asked about.
All steps read one shuffle of the texts.  Windows never cross documents.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbits as tb
from .ballots import ANSWER, BALLOT, Group, answered, deal, grouped, repeated, sent

_FAR = 1 << 40
#: Bytes of the digest that names a window.
DIGEST = 16
#: Buckets from here on carry a group's own notes back to it.
_OWN = 1 << 24
_RUN = np.uint64(0xC2B2AE3D27D4EB4F)
_PAIR = np.uint64(0x165667B19E3779F9)


def recompress(values: np.ndarray, first: np.ndarray, rounds: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names after the rounds, and the context [left, right) of words of each."""
    n = len(values)
    if not n:
        return values, np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    # runs of one word
    new = np.ones(n, bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, n))
    names, owner = values[at], owner[at]
    long = length > 1
    names = np.where(long, tb.mix(names ^ (length.astype(np.uint64) * _RUN)), names)
    left, right = at - 1, at + length + 1
    edge = np.ones(len(at), bool)
    edge[1:] = owner[1:] != owner[:-1]
    left[edge] = -_FAR
    right[np.append(edge[1:], True)] = _FAR
    for r in range(rounds):
        turn = np.uint64((r + 1) * int(_RUN) % (1 << 64))
        side = (tb.mix(names + turn) >> np.uint64(63)).astype(bool)  # False: left
        tied = np.zeros(len(names), bool)  # with the next one
        tied[:-1] = ~side[:-1] & side[1:] & (owner[:-1] == owner[1:])
        taken = np.zeros(len(names), bool)
        taken[1:] = tied[:-1]
        next_right, prev_left = np.full(len(names), _FAR), np.full(len(names), -_FAR)
        same = owner[:-1] == owner[1:]
        next_right[:-1][same] = right[1:][same]
        prev_left[1:][same] = left[:-1][same]
        joined = names.copy()
        joined[:-1] = np.where(tied[:-1], tb.mix(names[:-1] * _PAIR + names[1:]), names[:-1])
        left, right = np.where(side, np.minimum(prev_left, left), left), np.where(side, right, np.maximum(next_right, right))
        keep = ~taken
        names, left, right, owner = joined[keep], left[keep], right[keep], owner[keep]
    return names, left, right


class _Words:
    """The words of a group's texts."""

    def __init__(self, rows: pa.Table, window: int):
        self.of = of = Group(rows)
        self.start, self.end, self.first = tb.words(of.buf, of.offs)
        self.window = window

    @cached_property
    def values(self) -> np.ndarray:
        return tb.span_hash(self.of.buf, self.start, self.end)

    def candidates(self, answers: dict[int, bytes], n_buckets: int) -> np.ndarray:
        """Window starts that hold no whole context of a name that occurs once."""
        names, left, right = recompress(self.values, self.first)
        own, which, held = np.unique(names, return_inverse=True, return_counts=True)
        order, to = deal(own, n_buckets)
        twice = held > 1
        for b, bits in answers.items():
            twice[order[to[b] : to[b + 1]]] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=to[b + 1] - to[b]).astype(bool)
        twice = twice[which]
        once = np.flatnonzero(~twice & (right - left <= self.window))
        edge = np.zeros(len(self.values) + 1, np.int32)
        np.add.at(edge, np.maximum(right[once] - self.window, 0), 1)
        np.add.at(edge, left[once] + 1, -1)
        dead = np.cumsum(edge) > 0
        at, _ = tb.starts_of(self.first, self.window)
        return at[~dead[at]]

    def joined(self, stay: np.ndarray | None = None) -> tuple[bytes, np.ndarray]:
        """The words (those that stay) each followed by a space, and where each ends with its space."""
        start, end = (self.start, self.end) if stay is None else (self.start[stay], self.end[stay])
        size = end - start + 1
        ends = np.cumsum(size)
        line = np.append(self.of.buf, np.uint8(32))[tb.ranges(start, size)] if len(start) else np.zeros(0, np.uint8)
        line[ends - 1] = 32
        return line.tobytes(), ends


def digests(line: bytes, ends: np.ndarray, first: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """A cryptographic digest of the ``count`` words from each of ``first`` on in ``joined``, as two numbers."""
    begin = np.append(0, ends)[first]
    said = b"".join(hashlib.blake2b(line[a:z], digest_size=DIGEST).digest() for a, z in zip(begin.tolist(), ends[first + count - 1].tolist(), strict=True))
    high, low = np.frombuffer(said, "<u8").reshape(-1, 2).T
    return high, low


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, with_text: bool = True, name_bits: int = 64) -> DataFrame:
    """Returns ``id_col, n_words, n_removed, n_windows, kept_sha256`` for each row, and with
    ``with_text`` also ``kept_text``.

    Words are runs of other than ASCII white space, unchanged.  A word goes if a window
    of ``window`` words that covers it also starts earlier: in a smaller id, or earlier
    in the same text.  All windows are judged on the input.  kept_text joins the other
    words by one space; n_windows counts the windows that start earlier elsewhere.

    Cases: null, empty and short texts have nothing removed.  Rows that repeat an id are
    ordered in a way fixed by their texts, and count as separate documents.  Rows with a
    null id come last, likewise.  An empty table gives an empty result.
    A very long text is worked on whole.  Other columns of docs are ignored.
    ``name_bits`` cuts the first half of a name, which deals it; results do not depend on it.
    """
    mask = np.uint64((1 << name_bits) - 1)
    texts, n_buckets = grouped(docs, id_col, text_col)

    def ask_names(rows: pa.Table) -> pa.Table:
        w = _Words(rows, window)
        names = np.unique(recompress(w.values, w.first)[0])
        order, to = deal(names, n_buckets)
        small = (names[order] >> np.uint64(32)).astype("<u4")
        return sent(w.of.g, {b: small[to[b] : to[b + 1]].tobytes() for b in range(n_buckets) if to[b] < to[b + 1]})

    def names_twice(rows: pa.Table) -> pa.Table:
        blobs = rows.column("blob").to_pylist()
        flags = repeated(np.frombuffer(b"".join(blobs), "<u4"))
        ends = np.cumsum([len(x) // 4 for x in blobs])
        return answered(rows.column("g").to_pylist(), rows.column("bucket").to_pylist(), [np.packbits(x).tobytes() for x in np.split(flags, ends[:-1])])

    def ask_windows(rows: pa.Table, answers: pa.Table) -> pa.Table:
        w = _Words(rows, window)
        at = w.candidates(by_bucket(answers), n_buckets)
        name, check = digests(*w.joined(), at, window)
        name = name & mask
        first = np.sort(tb.unique_pairs(name, check)[0])
        out = {_OWN + w.of.g: at.astype("<i4").tobytes()}
        order, to = deal(name[first], n_buckets)
        first = first[order]
        name, check, asked = name[first].astype("<u8"), check[first].astype("<u8"), at[first]
        row = np.searchsorted(w.first, asked, "right") - 1
        for b in range(n_buckets):
            a, z = to[b], to[b + 1]
            if a < z:
                cut = np.flatnonzero(np.append(True, row[a + 1 : z] != row[a : z - 1]))
                runs = np.diff(np.append(cut, z - a)).astype("<i4")
                ids = w.of.ids[row[a:z][cut]].astype("<i8")
                out[b] = np.array([len(cut)], "<i4").tobytes() + ids.tobytes() + runs.tobytes() + name[a:z].tobytes() + check[a:z].tobytes()
        return sent(w.of.g, out)

    def windows_before(rows: pa.Table) -> pa.Table:
        """For each window asked about a bit, whether it starts earlier."""
        gs, buckets, blobs = (rows.column(c).to_pylist() for c in ("g", "bucket", "blob"))
        if buckets[0] >= _OWN:
            return answered(gs, buckets, blobs)
        order = sorted(range(len(gs)), key=gs.__getitem__)
        ids, runs, name, check, sizes = [], [], [], [], []
        for blob in (blobs[i] for i in order):
            k = int(np.frombuffer(blob, "<i4", 1)[0])
            run = np.frombuffer(blob, "<i4", k, 4 + 8 * k)
            m = int(run.sum())
            ids.append(np.frombuffer(blob, "<i8", k, 4))
            runs.append(run)
            name.append(np.frombuffer(blob, "<u8", m, 4 + 12 * k))
            check.append(np.frombuffer(blob, "<u8", m, 4 + 12 * k + 8 * m))
            sizes.append(m)
        ids, runs, name, check = map(np.concatenate, (ids, runs, name, check))
        by_id = np.argsort(ids, kind="stable")
        start = np.cumsum(runs) - runs
        corpus = tb.ranges(start[by_id], runs[by_id].astype(np.int64))  # corpus order
        later = np.ones(len(corpus), bool)
        later[corpus[tb.unique_pairs(name[corpus], check[corpus])[0]]] = False
        parts = np.split(later, np.cumsum(sizes)[:-1])
        return answered([gs[i] for i in order], [buckets[i] for i in order], [np.packbits(x).tobytes() for x in parts])

    def remove(rows: pa.Table, answers: pa.Table) -> pa.Table:
        w = _Words(rows, window)
        got, of = by_bucket(answers), w.of
        at = np.frombuffer(got.pop(_OWN + of.g, b""), "<i4").astype(np.int64)
        name, check = digests(*w.joined(), at, window)
        name = name & mask
        first = np.sort(tb.unique_pairs(name, check)[0])
        later = np.ones(len(at), bool)  # in the group itself the first of a kind stands for the others
        later[first] = False
        order, to = deal(name[first], n_buckets)
        asked = first[order]
        for b, blob in got.items():
            mine = asked[to[b] : to[b + 1]]
            later[mine[np.unpackbits(np.frombuffer(blob, np.uint8), count=len(mine)).astype(bool)]] = True
        gone = tb.covered(at[later], window, len(w.start))
        starts = np.zeros(len(w.start), bool)
        starts[at[later]] = True
        joined, ends = w.joined(~gone)
        byte = np.append(0, ends)[np.append(0, np.cumsum(~gone))[w.first]]
        kept = [joined[a : z - 1] if a < z else b"" for a, z in zip(byte[:-1].tolist(), byte[1:].tolist(), strict=True)]
        out = {
            id_col: of.id_column,
            "n_words": np.diff(w.first),
            "n_removed": tb.segment_sum(gone, w.first),
            "n_windows": tb.segment_sum(starts, w.first),
            "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept],
        }
        if with_text:
            out["kept_text"] = pa.array(kept, pa.binary()).cast(pa.string())
        return pa.table(out)

    names = texts.groupBy("g").applyInArrow(ask_names, BALLOT).groupBy("bucket").applyInArrow(names_twice, ANSWER)
    windows = texts.groupBy("g").cogroup(names.groupBy("g")).applyInArrow(ask_windows, BALLOT).groupBy("bucket").applyInArrow(windows_before, ANSWER)
    schema = f"`{id_col}` long, n_words long, n_removed long, n_windows long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return texts.groupBy("g").cogroup(windows.groupBy("g")).applyInArrow(remove, schema)


def by_bucket(answers: pa.Table) -> dict[int, bytes]:
    return dict(zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist(), strict=True))
