"""Quality rules: base counts, and repetition measured on a suffix array of words.

Suffixes take part if their first ``least_words`` words stand elsewhere in the same
text, with the few places after them where such repeats end.  They are sorted by prefix
doubling for all texts of a slice at once; longest common prefixes of neighbours
follow from the ranks of each doubling step.  Common-prefix intervals with diverse left
neighbours are the maximal repeats; their spans are united.  A text fails if the
repeats cover too large a part of it or one repeat is too long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbits as tb
from .ballots import repeated
from .suffix_dedup import intervals

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
RULES = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_repeats long, n_covered long, longest_repeat long"


def own(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The values, told apart by the text they are of."""
    owner = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    return tb.mix(values + tb.mix(owner + np.uint64(0x51ED270B)))


def suffix_array(values: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of suffixes in (text, values) order, and the common prefix of each with the next one.

    Taken are the places whose first ``least`` values recur in their text and the ``least``
    places after each, where their repeats end; so every repeat of ``least`` values and more
    is ordered exactly.  Shorter common prefixes, and those across texts, are given as 0.
    """
    at, to = tb.starts_of(first, least)
    again = at[repeated(own(tb.gram_hashes(values, least)[at], to))]
    place = np.flatnonzero(tb.covered(again, least + 1, len(values)))
    n = len(place)
    if not n:
        return place, np.zeros(0, np.int64)
    owner = np.searchsorted(first, place, "right") - 1
    index = np.full(len(values) + 1, -1, np.int64)
    index[place] = np.arange(n)
    ahead = [np.where(place + k < first[owner + 1], values[np.minimum(place + k, len(values) - 1)] | np.uint64(1), np.uint64(0)) for k in range(least)]
    order = np.lexsort((*ahead[::-1], owner))
    new = np.ones(n, bool)
    new[1:] = owner[order][1:] != owner[order][:-1]
    for v in ahead:
        new[1:] |= v[order][1:] != v[order][:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new) - 1
    levels, length = [(least, rank)], least
    while rank.max() < n - 1:
        follow = np.where(place + length < first[owner + 1], index[np.minimum(place + length, len(values))], -1)
        second = np.where(follow >= 0, rank[np.maximum(follow, 0)] + 1, 0)
        order = np.lexsort((second, rank))
        r, s = rank[order], second[order]
        new = np.ones(n, bool)
        new[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1])
        better = np.empty(n, np.int64)
        better[order] = np.cumsum(new) - 1
        if better.max() == rank.max():
            break
        rank = better
        length *= 2
        levels.append((length, rank))
    sa = np.argsort(rank, kind="stable")
    a, b = sa[:-1], sa[1:]
    off = np.zeros(len(a), np.int64)
    for length, level in reversed(levels):
        i, j = index[np.minimum(place[a] + off, len(values))], index[np.minimum(place[b] + off, len(values))]
        same = (i >= 0) & (j >= 0)
        same[same] = level[i[same]] == level[j[same]]
        off[same] += length
    end = first[owner + 1]
    live = owner[a] == owner[b]
    for _ in range(least - 1):
        x, y = place[a] + off, place[b] + off
        live &= (x < end[a]) & (y < end[b])
        live[live] = values[x[live]] == values[y[live]]
        off[live] += 1
    off[off < least] = 0
    return place[sa], off


def repetition(values: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: maximal repeats, values that they cover, and the longest of them."""
    place, lcp = suffix_array(values, first, least)
    n_texts = len(first) - 1
    number, longest = np.zeros(n_texts, np.int64), np.zeros(n_texts, np.int64)
    if not len(place):
        return number, np.zeros(n_texts, np.int64), longest
    owner = np.searchsorted(first, place, "right") - 1
    reach = np.maximum(np.append(lcp, 0), np.append(0, lcp))
    edge = np.zeros(len(values) + 1, np.int32)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + reach, -1)
    np.maximum.at(longest, owner, reach)
    left = np.where(place > first[owner], values[np.maximum(place - 1, 0)], np.uint64(0))
    odd = np.concatenate([[0], np.cumsum((left[1:] != left[:-1]) | (place[1:] == first[owner[1:]]))])
    for depth, a, z in intervals(lcp):
        if depth >= least and odd[z] > odd[a]:
            number[owner[a]] += 1
    return number, tb.segment_sum(np.cumsum(edge[:-1]) > 0, first), longest


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 6, most_covered: int = 30, longest_share: int = 25, longest_words: int = 40) -> DataFrame:
    """Returns ``id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, n_repeats, n_covered, longest_repeat`` for each row of docs.

    base_failed: under 20 words, or over 30 % of the words lie in 8-word windows found
    twice.  The suffix-array rule fails a text whose repeats of ``least_words`` words and more
    cover over ``most_covered`` % of its words, or whose longest repeat has over
    ``longest_words`` words and over ``longest_share`` % of the text's words.

    Cases: null and empty texts count 0 everywhere and fail the base rule.  Lines are parts
    between line feeds, compared byte by byte.  Repeated rows and null ids have results like any
    other row.  An empty table gives an empty result.  A very long text is judged whole, in a
    batch of its own.  Other columns of docs are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches):
            buf, offs = tb.text_buffer(batch.column("text"))
            start, end, first = tb.words(buf, offs)
            values = tb.span_hash(buf, start, end)
            n = np.diff(first)
            heads = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
            chars = tb.segment_sum(heads[end] - heads[start], first)
            symbols = tb.segment_sum(_SYMBOL[buf], offs)
            # lines with a word
            head = np.zeros(len(buf), bool)
            head[1:] = buf[:-1] == 10
            head[offs[:-1][offs[:-1] < len(buf)]] = True
            a = np.flatnonzero(head)
            z = np.append(a[1:], len(buf))
            z = z - ((z > a) & (buf[np.maximum(z - 1, 0)] == 10)) if len(a) else z[:0]
            worded = np.searchsorted(start, z) > np.searchsorted(start, a)
            a, z = a[worded], z[worded]
            line_first = np.searchsorted(a, offs)
            lines = np.diff(line_first)
            different = np.diff(tb.distinct(tb.span_hash(buf, a, z), line_first)[1])
            at, to = tb.starts_of(first, 8)
            twice = repeated(own(tb.gram_hashes(values, 8)[at], to))
            again = tb.segment_sum(tb.covered(at[twice], 8, len(values)), first)
            failed = (n < 20) | (100 * again > 30 * n)
            number, cover, longest = repetition(values, first, least_words)
            bad = (100 * cover > most_covered * n) | ((longest > longest_words) & (100 * longest > longest_share * n))
            columns = [n, chars, symbols, lines - different, again, failed, ~failed & ~bad, number, cover, longest]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, columns)], names=[c.split()[0] for c in RULES.split(", ")])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(run, RULES).withColumnRenamed("id", id_col)
