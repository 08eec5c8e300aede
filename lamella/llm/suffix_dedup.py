"""Removal of byte strings that occur more than once, by a sparse suffix array.

Every ``window``-byte string has one anchor: its least (fingerprint, place) 32-byte
gram, which depends on the string alone.  Equal strings therefore have the same gram
at the same distance, so it is enough to compare the surroundings of anchors: one
suffix in about ``window / 2`` bytes.  An anchor's *context* is the union of the
strings that it is the anchor of.

1. Groups send their distinct contexts, named by 128-bit cryptographic digests of their
   bytes, and for each gram how many contexts it has.  A gram of one context drops out;
   contexts that occur twice are repeats as a whole, and one of them stands for all.
2. The distinct contexts of the grams that remain meet in buckets.  There an enhanced
   suffix array (suffixes from the anchor on, longest common prefixes) is scanned with
   a stack into the tree of common-prefix intervals.  Each interval's left contexts
   are tested for diversity: if all agree far enough the interval is one repeat,
   else it splits by left context.  All members of an interval take part, not just neighbours.
3. Groups remove what is covered.

A gram of many contexts (a short passage in very many texts) is split: its strings
are told apart by how far left of the gram they start, in ``CLASSES`` classes.  All strings of
a class share the bytes that the shortest reach to either side has, so these bytes,
``window - window / CLASSES`` or more of them, are the class's key in place of the gram.  Two equal
strings are in one class and share its key, so nothing is lost, and of equal contexts
under one key a group sends one.

The three steps read one shuffle of the texts.  Matches never cross documents.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbits as tb
from .ballots import ANSWER, BALLOT, Group, answered, deal, grouped, sent, text_runs
from .shared import split_join, written

GRAM = 32
CLASSES = 8
_OWN = 1 << 24
_UNIQUE, _COVERED, _OPEN, _STANDS = range(4)
#: Added to the code of an anchor whose gram is split into classes.
_SPLIT = 4
_KEY = np.uint64(0x9FB21C651E98DF25)


class Rule(NamedTuple):
    """Strings of ``window`` bytes that stand more than once are covered, the first one too unless ``first_stays``."""

    window: int
    first_stays: bool = False
    name_bits: int = 64


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    size, block = 1, values
    while 2 * size <= width:
        block = np.minimum(block[:-size], block[size:])
        size *= 2
    return np.minimum(block[: len(values) - width + 1], block[width - size : width - size + len(values) - width + 1])


def named(raw: memoryview, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Cryptographic digests of raw[start:end], two numbers for each span."""
    said = b"".join(hashlib.blake2b(raw[a:z], digest_size=16).digest() for a, z in zip(start.tolist(), end.tolist(), strict=True))
    return np.frombuffer(said, "<u8").reshape(-1, 2)


class _Anchors:
    """Anchors of all strings of one rule in a group: place, first and last string start, gram, and the context's
    name: two numbers of a cryptographic digest, so that contexts of one name are equal."""

    def __init__(self, of: Group, rule: Rule, found: list[tuple[np.ndarray, ...]]):
        self.of, self.rule, self.window = of, rule, rule.window
        self.place, self.low, self.high, self.gram, self.context, self.check = map(np.concatenate, zip(*found, strict=True))

    @classmethod
    def of_rules(cls, rows: pa.Table, rules: list[Rule]) -> list[_Anchors]:
        """One for each rule; the grams of a text are fingerprinted once."""
        of = Group(rows)
        found = [cls._of_texts(of, i, j, rules) for i, j in text_runs(of.offs)]
        return [cls(of, rule, list(x)) for rule, x in zip(rules, zip(*found, strict=True), strict=True)]

    @staticmethod
    def _of_texts(of: Group, i: int, j: int, rules: list[Rule]) -> list[tuple[np.ndarray, ...]]:
        base = of.offs[i]
        buf, offs = of.buf[base : of.offs[j]], of.offs[i : j + 1] - base
        assert len(buf) < 1 << 32
        grams = tb.gram_hashes(tb.BYTE_VALUE[buf], GRAM)
        keyed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        raw, out = memoryview(np.ascontiguousarray(buf)), []
        for rule in rules:
            window = rule.window
            starts, _ = tb.starts_of(offs, window)
            if not len(starts):
                none = np.zeros(0, np.int64)
                out.append((none, none, none, *[none.astype(np.uint64)] * 3))
                continue
            least = sliding_least(keyed, window - GRAM + 1)[starts]
            at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
            new = np.ones(len(at), bool)
            new[1:] = at[1:] != at[:-1]
            first = np.flatnonzero(new)
            place, low = at[first], starts[first]
            high = starts[np.append(first[1:], len(starts)) - 1]
            context, check = named(raw, low, high + window).T
            out.append((place + base, low + base, high + base, grams[place], tb.mix(context + (place - low).astype(np.uint64)) & np.uint64((1 << rule.name_bits) - 1), check))
        return out

    def ids_at(self, place: np.ndarray) -> np.ndarray:
        """The document id at each place (the largest number where it is null)."""
        return self.of.ids[np.searchsorted(self.of.offs, place, "right") - 1]

    def gram_ballots(self, n_buckets: int) -> dict[int, bytes]:
        """For each bucket its grams, with their least and greatest context (by the second half of its name,
        which is enough among contexts of one gram) and the number of contexts."""
        order = np.lexsort((self.check, self.gram))
        g, c = self.gram[order], self.check[order]
        new_g, new_c = np.ones(len(g), bool), np.ones(len(g), bool)
        new_g[1:] = g[1:] != g[:-1]
        new_c[1:] = new_g[1:] | (c[1:] != c[:-1])
        at = np.flatnonzero(new_g)
        if not len(at):
            return {}
        columns = [g[at].astype("<u8"), c[at].astype("<u8"), c[np.append(at[1:], len(g)) - 1].astype("<u8"), np.add.reduceat(new_c, at, dtype="<i8")]
        order, to = deal(columns[0], n_buckets)
        columns = [x[order] for x in columns]
        return {b: b"".join(x[to[b] : to[b + 1]].tobytes() for x in columns) for b in range(n_buckets) if to[b] < to[b + 1]}

    def codes(self, answers: dict[int, bytes], n_buckets: int, split_above: int) -> np.ndarray:
        """For each anchor: unique gram, covered context, open context, or covered and standing for its class.

        Where the first stays, what stands for a class of equal contexts is its first member, which is open."""
        gram, of_gram = np.unique(self.gram, return_inverse=True)
        first, of_context, held = tb.unique_pairs(self.context, self.check)
        kinds, seen = np.zeros(len(gram), np.int64), np.zeros(len(first), np.uint8)
        by_gram, to_gram = deal(gram, n_buckets)
        by_context, to_context = deal(self.context[first], n_buckets)
        for b, blob in answers.items():
            if b < n_buckets:
                kinds[by_gram[to_gram[b] : to_gram[b + 1]]] = np.frombuffer(blob, "<i8")
            else:
                b -= n_buckets
                seen[by_context[to_context[b] : to_context[b + 1]]] = np.frombuffer(blob, np.uint8)
        again = ((seen > 0) | (held > 1))[of_context]
        stands = np.zeros(len(self.gram), bool)
        stands[first[seen != _AFTER]] = True
        kinds = kinds[of_gram]
        if self.rule.first_stays:
            code = np.where(again & ~stands, _COVERED, np.where(kinds > 1, _OPEN, _UNIQUE))
        else:
            code = np.where(again, np.where(stands & (kinds > 1), _STANDS, _COVERED), np.where(kinds > 1, _OPEN, _UNIQUE))
        return (code + _SPLIT * (kinds > split_above)).astype(np.uint8)


#: Answers about a context: in this group only, in others too and this is the first, or not the first.
_ALONE, _FIRST, _AFTER = range(3)


def judge_grams(gram: np.ndarray, least: np.ndarray, most: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each gram of each group: 1 if all groups have one and the same context, else the sum of their counts."""
    order = np.argsort(gram, kind="stable")
    new = np.ones(len(gram), bool)
    new[1:] = gram[order][1:] != gram[order][:-1]
    at = np.flatnonzero(new)
    same = np.minimum.reduceat(least[order], at) == np.maximum.reduceat(most[order], at)
    kinds = np.where(same, 1, np.add.reduceat(count[order], at))
    out = np.empty(len(gram), np.int64)
    out[order] = kinds[np.cumsum(new) - 1]
    return out


def judged_grams(rows: pa.Table) -> pa.Table:
    """Answers to all groups' ``gram_ballots`` of one bucket."""
    gs, buckets, blobs = (rows.column(c).to_pylist() for c in ("g", "bucket", "blob"))
    asked = [np.frombuffer(x, "<u8").reshape(4, -1) for x in blobs]
    gram, least, most, count = np.concatenate(asked, axis=1)
    said = judge_grams(gram, least, most, count.astype(np.int64))
    return answered(gs, buckets, [x.tobytes() for x in np.split(said, np.cumsum([x.shape[1] for x in asked])[:-1])])


def judge_contexts(context: np.ndarray, check: np.ndarray, doc: np.ndarray, g: np.ndarray) -> np.ndarray:
    """For each context of each group, whether others have it and whether this group is the first, by document and group."""
    order = np.lexsort((g, doc, check, context))
    new = np.ones(len(context), bool)
    new[1:] = (context[order][1:] != context[order][:-1]) | (check[order][1:] != check[order][:-1])
    size = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
    out = np.empty(len(context), np.uint8)
    out[order] = np.where(size == 1, _ALONE, np.where(new, _FIRST, _AFTER))
    return out


class _Parts:
    """What is compared: the open anchors, those of split grams once per class of windows.

    ``place, low, high, key`` as for anchors; ``same`` says that the group has an equal
    context under the key, and ``asked`` which part stands for each.
    """

    def __init__(self, a: _Anchors, code: np.ndarray):
        window, reach = a.window, a.window - GRAM
        plain = np.flatnonzero((code == _OPEN) | (code == _STANDS))
        split = np.flatnonzero(code >= _SPLIT + _OPEN)
        self.place, self.low, self.high, self.key = a.place[plain], a.low[plain], a.high[plain], a.gram[plain]
        self.same, self.asked = np.zeros(len(plain), bool), np.arange(len(plain))
        if not len(split):
            return
        place, low, high, first, last, of_class = [], [], [], [], [], []
        step = -(-(reach + 1) // CLASSES)
        for j, least in enumerate(range(0, reach + 1, step)):
            most = min(least + step - 1, reach)
            at = a.place[split]
            left, right = np.maximum(at - a.high[split], least), np.minimum(at - a.low[split], most)
            mine = left <= right
            at, left, right = at[mine], left[mine], right[mine]
            place.append(at)
            low.append(at - right)
            high.append(at - left)
            first.append(at - least)
            last.append(at + window - most)
            of_class.append(np.full(len(at), j, np.uint64))
        place, low, high, first, last, of_class = map(np.concatenate, (place, low, high, first, last, of_class))
        raw = memoryview(np.ascontiguousarray(a.of.buf))
        key = tb.mix(named(raw, first, last)[:, 0] + of_class * _KEY)
        context, check = named(raw, low, high + window).T
        context = tb.mix(context + (place - low).astype(np.uint64))
        order = np.lexsort((check, context, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (context[order][1:] != context[order][:-1]) | (check[order][1:] != check[order][:-1])
        kind = np.cumsum(new) - 1
        asked, same = np.empty(len(order), np.int64), np.empty(len(order), bool)
        asked[order] = order[new][kind]
        same[order] = ~new if a.rule.first_stays else np.bincount(kind)[kind] > 1
        self.asked = np.concatenate([self.asked, asked + len(plain)])
        self.same = np.concatenate([self.same, same])
        self.place, self.low, self.high, self.key = (np.concatenate(x) for x in ((self.place, place), (self.low, low), (self.high, high), (self.key, key)))


def _ordered(gram: np.ndarray, rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (gram, row bytes) and the common prefix with the next one (-1 across grams)."""
    keys = np.ascontiguousarray(np.concatenate([gram.astype(">u8").view(np.uint8).reshape(-1, 8), rows], axis=1))
    order = np.argsort(keys.view(f"V{keys.shape[1]}").ravel(), kind="stable")
    lcp = np.empty(max(len(order) - 1, 0), np.int64)
    for a in range(0, len(lcp), 4096):
        x, y = order[a : a + 4096], order[a + 1 : a + 4097]
        x = x[: len(y)]
        differ = rows[x] != rows[y]
        at = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        at = np.minimum(at, np.minimum(length[x], length[y]))
        lcp[a : a + len(y)] = np.where(gram[x] == gram[y], at, -1)
    return order, lcp


def intervals(lcp: np.ndarray) -> list[tuple[int, int, int]]:
    """Common-prefix intervals (depth, first, last) of a suffix array by one scan with a stack."""
    out, stack = [], []
    for i, depth in enumerate(lcp.tolist() + [-1]):
        left = i
        while stack and stack[-1][0] > depth:
            d, left = stack.pop()
            out.append((d, left, i))
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, left))
    return out


def _surroundings(data: np.ndarray, start: np.ndarray, left: np.ndarray, size: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of bytes to the right of each anchor, and of those to its left from the anchor on, with their lengths."""
    n, r_len = len(start), size - left
    right, back = np.zeros((n, window), np.uint8), np.zeros((n, window), np.uint8)
    row = np.repeat(np.arange(n), r_len)
    right[row, tb.ranges(np.zeros(n, np.int64), r_len)] = data[tb.ranges(start + left, r_len)]
    row, col = np.repeat(np.arange(n), left), tb.ranges(np.zeros(n, np.int64), left)
    back[row, col] = data[(start + left - 1)[row] - col]
    return right, r_len, back, left


def maximal_groups(gram: np.ndarray, right: np.ndarray, right_len: np.ndarray, left: np.ndarray, left_len: np.ndarray, window: int) -> list[tuple[int, int, np.ndarray]]:
    """(bytes left of the anchor, bytes right of it, contexts) of every maximal repeat of ``window`` bytes or more.

    In each common-prefix interval the members are put in the order of their left contexts,
    whose common extensions form a tree as well.  A node of it is a maximal repeat if its
    members agree on no more to the left than it says (they are a node) and go on differently
    to the right (they do not all lie in one child of the interval)."""
    out: list[tuple[int, int, np.ndarray]] = []
    if len(gram) < 2:
        return out
    order, lcp = _ordered(gram, right, right_len)
    by_left, left_lcp = _ordered(gram, left, left_len)
    rank = np.empty(len(gram), np.int64)
    rank[by_left] = np.arange(len(gram))
    rank_of = rank[order]
    left_lcp = np.append(left_lcp, -1)
    for depth, a, z in intervals(lcp):
        child = np.concatenate([[0], np.cumsum(lcp[a:z] == depth)])
        in_left = np.argsort(rank_of[a : z + 1])
        r, child = rank_of[a : z + 1][in_left], child[in_left]
        between = np.minimum.reduceat(left_lcp, r)[:-1]
        if between.max() + depth < window:
            continue
        for reach, p, q in intervals(between):
            if reach + depth >= window and child[p : q + 1].min() < child[p : q + 1].max():
                out.append((reach, depth, by_left[r[p : q + 1]]))
    return out


def nearest_earlier(between: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each member of a line the longest common extension with a member of lower order (-1: none).

    ``between`` holds the common extensions of neighbours.  The best partner is the next one of lower
    order on either side, which a scan with a stack finds."""
    best = np.full(len(order), -1, np.int64)
    for step in (1, -1):
        stack: list[tuple[int, int]] = []  # (order, extension shared with the one below)
        line = range(len(order)) if step == 1 else range(len(order) - 1, -1, -1)
        for t in line:
            shared = -1
            if stack:
                shared = int(between[t - 1] if step == 1 else between[t])
            while stack and stack[-1][0] > order[t]:
                shared = min(shared, stack.pop()[1])
            best[t] = max(best[t], shared if stack else -1)
            stack.append((int(order[t]), shared))
    return best


def repeats(gram: np.ndarray, right: np.ndarray, right_len: np.ndarray, left: np.ndarray, left_len: np.ndarray, window: int, earlier: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each context how far left and right of its anchor it is covered by repeats of ``window`` bytes.

    With ``earlier``, a number per context in the order of the corpus, only repeats of lower ones count.
    Depths grow along a branch of the tree and are at most ``window``, which bounds the work per context.
    """
    n = len(gram)
    lo, hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n < 2:
        return lo, hi
    order, lcp = _ordered(gram, right, right_len)
    by_left, left_lcp = _ordered(gram, left, left_len)
    rank = np.empty(n, np.int64)
    rank[by_left] = np.arange(n)
    rank_of = rank[order]
    left_lcp = np.append(left_lcp, -1)
    for depth, a, z in intervals(lcp):
        need = window - depth
        if z == a + 1:
            x, y = rank_of[a], rank_of[z]
            if x > y:
                x, y = y, x
            reach = int(left_lcp[x:y].min())
            if reach >= need:
                pair = (order[a], order[z])
                if earlier is not None:
                    pair = (max(pair, key=earlier.__getitem__),)
                for i in pair:
                    lo[i], hi[i] = max(lo[i], reach), max(hi[i], depth)
            continue
        r = np.sort(rank_of[a : z + 1])
        between = np.minimum.reduceat(left_lcp, r)[:-1]
        if between.max() < need:  # left contexts differ too early everywhere
            continue
        members = by_left[r]
        if earlier is not None:
            best = nearest_earlier(between, earlier[members])
        else:
            best = np.maximum(np.append(between, -1), np.append(-1, between))
        ok = best >= need
        chosen = members[ok]
        lo[chosen] = np.maximum(lo[chosen], best[ok])
        hi[chosen] = np.maximum(hi[chosen], depth)
    return lo, hi


def covered_bytes(a: _Anchors, code: np.ndarray, answers: dict[int, bytes], n_buckets: int) -> np.ndarray:
    """Which bytes of the group the rule covers."""
    n, window = len(a.of.buf), a.window
    edge = np.zeros(n + 1, np.int32)
    if len(code):
        whole = np.isin(code % _SPLIT, (_COVERED, _STANDS))
        np.add.at(edge, a.low[whole], 1)
        np.add.at(edge, a.high[whole] + window, -1)
        p = _Parts(a, code)
        np.add.at(edge, p.low[p.same], 1)
        np.add.at(edge, p.high[p.same] + window, -1)
        reach = np.zeros((2, len(p.place)), np.int64)
        pick = np.unique(p.asked)
        order, to = deal(p.key[pick], n_buckets)
        for b, blob in answers.items():
            reach[:, pick[order[to[b] : to[b + 1]]]] = np.frombuffer(blob, "<u2").reshape(2, -1)
        lo, hi = reach[:, p.asked]
        some = lo + hi >= window
        np.add.at(edge, (p.place - lo)[some], 1)
        np.add.at(edge, (p.place + hi)[some], -1)
    return np.cumsum(edge[:-1]) > 0


def runs(flags: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal runs of flagged bytes, none of which crosses a text."""
    start, end = flags.copy(), flags.copy()
    start[1:] &= ~flags[:-1]
    end[:-1] &= ~flags[1:]
    firsts = offs[:-1][offs[:-1] < len(flags)]
    start[firsts] = flags[firsts]
    lasts = offs[1:][offs[1:] > 0] - 1
    end[lasts] = flags[lasts]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def whole_words(start: np.ndarray, end: np.ndarray, word_start: np.ndarray, word_end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs that hold ``least`` whole words or more, cut to those words."""
    first, last = np.searchsorted(word_start, start), np.searchsorted(word_end, end, "right")
    some = last - first >= max(least, 1)
    return word_start[first[some]], word_end[last[some] - 1]


def suffix_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 400, first_stays: bool = False, least_words: int = 0, passage: int | None = None, passage_words: int = 50,
    with_text: bool = True, carry: tuple[str, ...] = (), split_above: int = 2000, name_bits: int = 64,
) -> DataFrame:
    """Returns ``id_col, n_bytes, n_removed, n_spans, kept_sha256`` for each row, with ``passage``
    also ``n_passages, n_passage_bytes``, and with ``with_text`` also ``kept_text`` and ``spans``
    (start, end in bytes).

    A byte goes if a string of ``window`` bytes that covers it also starts anywhere else,
    in the same text or another; overlaps count and all strings are judged on the input.
    With ``first_stays`` it goes only if such a string starts earlier: in a lower id, or before
    it in the same text.  With ``least_words`` a maximal run of such bytes goes only if it
    holds that many whole words, and is cut to them.
    n_spans counts the maximal removed runs.  kept_sha256 is of the remaining bytes.
    kept_text never cuts a character: a span that ends within one leaves that character.
    n_passages counts the runs of ``passage_words`` whole words or more in what strings of ``passage``
    bytes that stand more than once cover, first copies included; nothing is removed for them.
    The columns named in ``carry`` come along; a gram of more than ``split_above`` contexts is split.
    ``name_bits`` cuts the first half of a context's name, which deals it; results do not depend on it.

    Cases: null and empty texts have no bytes; texts under ``window`` bytes lose nothing;
    rows that repeat (also in their id) count as documents of their own, in the order of their
    texts, so their texts go if long enough.  Null ids are allowed and come last.  An empty table
    gives an empty result.  A very long text is worked on whole.  Other columns of docs are ignored.
    """
    rules = [Rule(window, first_stays, name_bits)] + ([Rule(passage, name_bits=name_bits)] if passage else [])
    if min(r.window for r in rules) < 2 * GRAM:
        raise ValueError(f"strings must have at least {2 * GRAM} bytes")
    texts, n_buckets = grouped(docs, id_col, text_col, carry)
    span = 2 * n_buckets  # buckets of a rule: for grams, and then for contexts

    def by_rule(table: pa.Table) -> list[dict[int, bytes]]:
        """The answers about each rule, by bucket; a group's own notes have bucket -1."""
        out: list[dict[int, bytes]] = [{} for _ in rules]
        for b, blob in zip(table.column("bucket").to_pylist(), table.column("blob").to_pylist(), strict=True):
            if b >= _OWN:
                out[b // _OWN - 1][-1] = blob
            else:
                out[b // span][b % span] = blob
        return out

    def ask_grams(rows: pa.Table) -> pa.Table:
        out = {}
        for k, a in enumerate(_Anchors.of_rules(rows, rules)):
            out |= {k * span + b: blob for b, blob in a.gram_ballots(n_buckets).items()}
            first = tb.unique_pairs(a.context, a.check)[0]
            order, to = deal(a.context[first], n_buckets)
            first = first[order]
            columns = [a.context[first].astype("<u8"), a.check[first].astype("<u8")]
            if a.rule.first_stays:
                columns.append(a.ids_at(a.place[first]).astype("<i8"))
            out |= {k * span + n_buckets + b: b"".join(x[to[b] : to[b + 1]].tobytes() for x in columns) for b in range(n_buckets) if to[b] < to[b + 1]}
            of = a.of
        return sent(of.g, out)

    def judge(rows: pa.Table) -> pa.Table:
        gs, buckets, blobs = (rows.column(c).to_pylist() for c in ("g", "bucket", "blob"))
        k, b = divmod(buckets[0], span)
        if b < n_buckets:
            return judged_grams(rows)
        asked = [np.frombuffer(x, "<u8").reshape(2 + rules[k].first_stays, -1) for x in blobs]
        sizes = [x.shape[1] for x in asked]
        both = np.concatenate(asked, axis=1)
        doc = both[2].view(np.int64) if rules[k].first_stays else np.zeros(both.shape[1], np.int64)
        said = judge_contexts(both[0], both[1], doc, np.repeat(gs, sizes))
        return answered(gs, buckets, [x.tobytes() for x in np.split(said, np.cumsum(sizes)[:-1])])

    def ask_contexts(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = {}
        for k, (a, got) in enumerate(zip(_Anchors.of_rules(rows, rules), by_rule(answers), strict=True)):
            code = a.codes(got, n_buckets, split_above)
            out[_OWN * (k + 1) + a.of.g] = code.tobytes()
            p = _Parts(a, code)
            pick = np.unique(p.asked)
            order, to = deal(p.key[pick], n_buckets)
            pick = pick[order]
            for b in range(n_buckets):
                mine = pick[to[b] : to[b + 1]]
                if len(mine):
                    left, size = p.place[mine] - p.low[mine], p.high[mine] + a.window - p.low[mine]
                    columns = [p.key[mine].astype("<u8")]
                    if a.rule.first_stays:
                        columns += [a.ids_at(p.place[mine]).astype("<i8"), p.place[mine].astype("<i8")]
                    columns += [left.astype("<u2"), size.astype("<u2"), a.of.buf[tb.ranges(p.low[mine], size)]]
                    out[k * span + b] = np.array([len(mine)], "<i4").tobytes() + b"".join(x.tobytes() for x in columns)
            of = a.of
        return sent(of.g, out)

    def compare(rows: pa.Table) -> pa.Table:
        gs, buckets, blobs = (rows.column(c).to_pylist() for c in ("g", "bucket", "blob"))
        if buckets[0] >= _OWN:
            return answered(gs, buckets, blobs)
        rule = rules[buckets[0] // span]
        kinds = ["<u8", "<i8", "<i8", "<u2", "<u2"] if rule.first_stays else ["<u8", "<u2", "<u2"]
        counts, fields = [], [[] for _ in range(len(kinds) + 1)]
        for blob in blobs:
            k, at = int(np.frombuffer(blob, "<i4", 1)[0]), 4
            counts.append(k)
            for field, kind in zip(fields, kinds, strict=False):
                field.append(np.frombuffer(blob, kind, k, at))
                at += field[-1].nbytes
            fields[-1].append(np.frombuffer(blob, np.uint8, -1, at))
        gram, *where, left, size, data = map(np.concatenate, fields)
        left, size = left.astype(np.int64), size.astype(np.int64)
        earlier = None
        if rule.first_stays:
            earlier = np.empty(len(gram), np.int64)
            earlier[np.lexsort((where[1], np.repeat(gs, counts), where[0]))] = np.arange(len(gram))
        start = np.cumsum(size) - size
        lo, hi = np.zeros(len(gram), np.int64), np.zeros(len(gram), np.int64)
        by_gram = np.argsort(gram, kind="stable")
        edges = np.flatnonzero(np.append(True, gram[by_gram][1:] != gram[by_gram][:-1]))
        edges = np.append(edges, len(gram))
        at = 0
        while at < len(edges) - 1:  # runs of whole grams, about 8,000 contexts each
            to = max(at + 1, int(np.searchsorted(edges, edges[at] + 8000, "right")) - 1)
            mine = by_gram[edges[at] : edges[to]]
            right, r_len, back, l_len = _surroundings(data, start[mine], left[mine], size[mine], rule.window)
            lo[mine], hi[mine] = repeats(gram[mine], right, r_len, back, l_len, rule.window, None if earlier is None else earlier[mine])
            at = to
        parts = np.split(np.stack([lo, hi]).astype("<u2"), np.cumsum(counts)[:-1], axis=1)
        return answered(gs, buckets, [np.ascontiguousarray(x).tobytes() for x in parts])

    def remove(rows: pa.Table, answers: pa.Table) -> pa.Table:
        masks = []
        for a, got in zip(_Anchors.of_rules(rows, rules), by_rule(answers), strict=True):
            masks.append(covered_bytes(a, np.frombuffer(got.pop(-1, b""), np.uint8), got, n_buckets))
            of = a.of
        n, gone = len(of.buf), masks[0]
        spans_of = lambda at: np.diff(np.searchsorted(at, of.offs))
        if least_words or passage:
            word_start, word_end, _ = tb.words(of.buf, of.offs)
        start, end = runs(gone, of.offs)
        if least_words:
            start, end = whole_words(start, end, word_start, word_end, least_words)
            gone = np.zeros(n, bool)
            gone[tb.ranges(start, end - start)] = True
        kept_at = np.concatenate([[0], np.cumsum(~gone)])[of.offs]
        left_over = of.buf[~gone].tobytes()
        out = {
            id_col: of.id_column,
            "n_bytes": np.diff(of.offs),
            "n_removed": tb.segment_sum(gone, of.offs),
            "n_spans": spans_of(start),
            "kept_sha256": [hashlib.sha256(left_over[x:y]).hexdigest() for x, y in zip(kept_at[:-1].tolist(), kept_at[1:].tolist(), strict=True)],
        }
        if passage:
            first, last = whole_words(*runs(masks[1], of.offs), word_start, word_end, passage_words)
            out["n_passages"] = spans_of(first)
            out["n_passage_bytes"] = tb.segment_sum(last - first, np.searchsorted(first, of.offs))
        if with_text:
            # a character stays whole if any byte of it stays
            lead = (of.buf & 0xC0) != 0x80
            char = np.cumsum(lead) - 1
            whole = np.ones(int(lead.sum()), bool)
            whole[char[~gone]] = False
            leave = ~whole[char] if n else np.zeros(0, bool)
            text_at = np.concatenate([[0], np.cumsum(leave)])[of.offs].astype(np.int32)
            out["kept_text"] = pa.StringArray.from_buffers(len(of.ids), pa.py_buffer(text_at), pa.py_buffer(of.buf[leave].tobytes()))
            base = np.repeat(of.offs[:-1], out["n_spans"])
            items = pa.StructArray.from_arrays([pa.array(start - base), pa.array(end - base)], ["start", "end"])
            out["spans"] = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(out["n_spans"])]).astype(np.int32), items)
        for k, name in enumerate(carry):
            out[name] = of.rows.column(f"c{k}")
        return pa.table(out)

    grams = texts.groupBy("g").applyInArrow(ask_grams, BALLOT).groupBy("bucket").applyInArrow(judge, ANSWER)
    contexts = texts.groupBy("g").cogroup(grams.groupBy("g")).applyInArrow(ask_contexts, BALLOT).groupBy("bucket").applyInArrow(compare, ANSWER)
    schema = f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if passage:
        schema += ", n_passages long, n_passage_bytes long"
    if with_text:
        schema += ", kept_text string, spans array<struct<start: long, end: long>>"
    schema += "".join(f", `{name}` {docs.schema[name].dataType.simpleString()}" for name in carry)
    return texts.groupBy("g").cogroup(contexts.groupBy("g")).applyInArrow(remove, schema)


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 400) -> DataFrame:
    """Returns ``repeat_id, id_col, start, n_bytes``: every occurrence of every maximal repeat of ``window`` bytes or more.

    A repeat is named by a fingerprint of its bytes; start counts bytes of the text.  The
    bytes around an anchor are seen up to ``window`` to the right and ``window - 32`` to the
    left, so a longer repeat comes as a chain of repeats that overlap.  For each string of
    ``window`` bytes that stands more than once there is a repeat with all its occurrences.

    Each group sends a distinct context once; occurrences join their context afterwards,
    and those of a hot context are split over tasks.

    Cases: null, empty and short texts have no repeats; rows that repeat are texts of their
    own; null ids stay null; an empty table gives an empty result.  Other columns are ignored.
    """
    rules = [Rule(window)]
    texts, n_buckets = grouped(docs, id_col, text_col)

    def ask_grams(rows: pa.Table) -> pa.Table:
        (a,) = _Anchors.of_rules(rows, rules)
        return sent(a.of.g, a.gram_ballots(n_buckets))

    def places(rows: pa.Table) -> pa.Table:
        (a,) = _Anchors.of_rules(rows, rules)
        row = np.searchsorted(a.of.offs, a.place, "right") - 1
        return pa.table({"context": a.context.view(np.int64), "id": a.of.id_column.take(pa.array(row)), "row": row, "low": a.low - a.of.offs[row], "at_left": a.place - a.low, "size": a.high + window - a.low})

    def ask_contexts(rows: pa.Table, answers: pa.Table) -> pa.Table:
        (a,) = _Anchors.of_rules(rows, rules)
        gram, of_gram = np.unique(a.gram, return_inverse=True)
        kinds = np.zeros(len(gram), np.int64)
        order, to = deal(gram, n_buckets)
        for b, blob in zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist(), strict=True):
            kinds[order[to[b] : to[b + 1]]] = np.frombuffer(blob, "<i8")
        open_ = np.flatnonzero(kinds[of_gram] > 1)
        pick = open_[np.unique(a.context[open_], return_index=True)[1]]
        order, to = deal(a.gram[pick], n_buckets)
        pick, out = pick[order], {}
        for b in range(n_buckets):
            mine = pick[to[b] : to[b + 1]]
            if len(mine):
                size = a.high[mine] + window - a.low[mine]
                columns = [a.gram[mine].astype("<u8"), a.context[mine].astype("<u8"), (a.place[mine] - a.low[mine]).astype("<u2"), size.astype("<u2"), a.of.buf[tb.ranges(a.low[mine], size)]]
                out[b] = np.array([len(mine)], "<i4").tobytes() + b"".join(x.tobytes() for x in columns)
        return sent(a.of.g, out)

    def compare(rows: pa.Table) -> pa.Table:
        fields = [[] for _ in range(5)]
        for blob in rows.column("blob").to_pylist():
            k, at = int(np.frombuffer(blob, "<i4", 1)[0]), 4
            for field, kind in zip(fields, ("<u8", "<u8", "<u2", "<u2"), strict=False):
                field.append(np.frombuffer(blob, kind, k, at))
                at += field[-1].nbytes
            fields[4].append(np.frombuffer(blob, np.uint8, -1, at))
        gram, context, left, size, data = map(np.concatenate, fields)
        left, size = left.astype(np.int64), size.astype(np.int64)
        start = np.cumsum(size) - size
        single = np.unique(context, return_index=True)[1]
        single = single[np.argsort(gram[single], kind="stable")]
        edges = np.append(np.flatnonzero(np.append(True, gram[single][1:] != gram[single][:-1])), len(single))
        who, lo, hi, at = [], [], [], 0
        while at < len(edges) - 1:
            to = max(at + 1, int(np.searchsorted(edges, edges[at] + 8000, "right")) - 1)
            mine = single[edges[at] : edges[to]]
            right, r_len, back, l_len = _surroundings(data, start[mine], left[mine], size[mine], window)
            for reach, depth, members in maximal_groups(gram[mine], right, r_len, back, l_len, window):
                who.append(mine[members])
                lo.append(np.full(len(members), reach))
                hi.append(np.full(len(members), depth))
            at = to
        who, lo, hi = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (who, lo, hi))
        name = tb.span_hash(data, (start + left)[who] - lo, (start + left)[who] + hi)
        return pa.table({"context": context[who].view(np.int64), "repeat_id": name.view(np.int64), "shift": left[who] - lo, "n_bytes": lo + hi})

    grams = texts.groupBy("g").applyInArrow(ask_grams, BALLOT).groupBy("bucket").applyInArrow(judged_grams, ANSWER)
    asked = texts.groupBy("g").cogroup(grams.groupBy("g")).applyInArrow(ask_contexts, BALLOT)
    parts = written(asked.groupBy("bucket").applyInArrow(compare, "context long, repeat_id long, shift long, n_bytes long").distinct(), "parts")
    found = written(texts.groupBy("g").applyInArrow(places, "context long, id long, row long, low long, at_left long, size long"), "places")
    # a context that stands more than once is a repeat as a whole
    counts = found.groupBy("context").agg(F.count("*").alias("__n"), F.max("size").alias("size"))
    whole = counts.where("__n > 1").select("context", F.col("context").alias("repeat_id"), F.lit(0).cast("long").alias("shift"), F.col("size").alias("n_bytes"))
    of_context = parts.union(whole).groupBy("context").agg(F.collect_list(F.struct("repeat_id", "shift", "n_bytes")).alias("in"))  # at most window ** 2
    rows = split_join(found, of_context.join(counts.select("context", "__n"), "context"), ["context"], found.count(), ["id", "row", "low"])
    each = rows.select("id", "row", "low", F.explode("in").alias("p")).select(F.col("p.repeat_id").alias("repeat_id"), "id", "row", (F.col("low") + F.col("p.shift")).alias("start"), F.col("p.n_bytes").alias("n_bytes"))
    return each.distinct().select("repeat_id", F.col("id").alias(id_col), "start", "n_bytes")
