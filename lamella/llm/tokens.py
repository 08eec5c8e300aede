"""Token ids of whole texts through the ``tokenizers`` library, a batch at a time.

A text is cut into pieces only where the tokenizer itself always ends a pre-token:
before a space that a visible character follows, around a line feed that a visible
character follows, and between an ASCII letter and ASCII punctuation.  The ids of a text are
those of its pieces in order.  Every Python worker remembers the ids of the pieces it
has met under a 64-bit fingerprint, so the library encodes a distinct piece once.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from . import textbits as tb

#: Pieces, and ids of pieces, that a worker remembers before it starts anew (about 20 bytes and 4 bytes each).
MEMORY_PIECES, MEMORY_IDS = 2_000_000, 16_000_000

_SPACE, _FEED, _QUOTE = 32, 10, 39
_INK = np.zeros(256, bool)
_INK[33:127] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PUNCT = _INK & ~_LETTER
_PUNCT[48:58] = False
_AHEAD = _INK.copy()
_AHEAD[[*range(0xC3, 0xE1), *range(0xE4, 0xF5)]] = True  # leads of characters that are never white space
_PLAIN = _LETTER.copy()
_PLAIN[0xC3] = True
_PLAIN[0x80:0xC0] = True
_PLAIN[[0x97, 0xB7]] = False  # the signs for times and divided by
_workers: dict[str, PieceEncoder] = {}


class PieceEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fold = "Lowercase" in json.dumps(json.loads(self.tokenizer.to_str())["normalizer"])
        self.between = self.tokenizer.encode("0", add_special_tokens=False).ids[0]
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # ascending
        self.length, self.start = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0

    def _encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of pieces that may stand next to each other in any order."""
        length, parts = np.zeros(len(pieces), np.int64), []
        for a in range(0, len(pieces), 2000):  # letters only: many at once, told apart by a digit
            text = "0".join(x.decode() for x in pieces[a : a + 2000])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            mark = ids == self.between
            edge = np.concatenate([[-1], np.flatnonzero(mark), [len(ids)]])
            length[a : a + 2000] = np.diff(edge) - 1
            parts.append(ids[~mark])
        return length, np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def _encode_any(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lists = [x.ids for x in self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
        length = np.fromiter(map(len, lists), np.int64, len(lists))
        return length, np.fromiter((i for x in lists for i in x), np.uint32, int(length.sum()))

    def _learn(self, keys: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        plain_before = np.concatenate([[0], np.cumsum(~_PLAIN[buf])])
        body = start + (buf[start] == _SPACE)
        plain = (plain_before[end] == plain_before[body]) & (end > body)
        raw = buf.tobytes()
        for chosen, encode in ((np.flatnonzero(plain), self._encode), (np.flatnonzero(~plain), self._encode_any)):
            if not len(chosen):
                continue
            length, ids = encode([raw[a:z] for a, z in zip(start[chosen].tolist(), end[chosen].tolist(), strict=True)])
            while self.used + len(ids) > len(self.flat):
                self.flat = np.resize(self.flat, 2 * len(self.flat))
            self.flat[self.used : self.used + len(ids)] = ids
            new = keys[chosen]
            order = np.argsort(new)
            at = np.searchsorted(self.keys, new[order])
            self.keys = np.insert(self.keys, at, new[order])
            self.length = np.insert(self.length, at, length[order])
            self.start = np.insert(self.start, at, (self.used + np.cumsum(length) - length)[order])
            self.used += len(ids)

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and each text's first one."""
        n = len(buf)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        here, after = buf[:-1], buf[1:]
        opens = (here == 60) & (after == 124)  # "<|": a special token may stand here
        special = bool(opens.any())
        cut = np.zeros(n, bool)
        ahead, feed = _AHEAD[after], here == _FEED
        edges = offs[1:-1]
        ahead[edges[(edges > 0) & (edges < n)] - 1] = False  # what follows is another text
        ahead[:-1] &= ~opens[1:]  # white space before a special token ends its text
        cut[:-1] = (here == _SPACE) & ahead
        cut[1:-1] |= feed[1:] & ahead[1:]  # white space before it is a pre-token of its own
        cut[1:] |= feed & ahead
        if not special:
            letter, punct = _LETTER[buf], _PUNCT[buf]
            cut[1:] |= (letter[:-1] & punct[1:]) | (punct[:-1] & letter[1:] & (here != _QUOTE))
        cut[offs[:-1][offs[:-1] < n]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        hashes = tb.span_hash(buf, start, end, lower=self.fold and not special)
        coded = pa.array(hashes).dictionary_encode()
        index, keys = np.asarray(coded.indices), np.asarray(coded.dictionary)
        if len(self.keys) + len(keys) > MEMORY_PIECES or self.used > MEMORY_IDS:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        if not known.all():
            one = np.empty(len(keys), np.int64)
            one[index] = np.arange(len(index))  # some place of each piece
            new = np.flatnonzero(~known)
            self._learn(keys[new], buf, start[one[new]], end[one[new]])
            at = np.searchsorted(self.keys, keys)
        length = self.length[at].astype(np.int64)[index]
        ids = self.flat[tb.ranges(self.start[at][index], length)]
        to = np.concatenate([[0], np.cumsum(length)])
        return ids, to[np.searchsorted(start, offs)]


def encoder(path: str) -> PieceEncoder:
    """The worker's own encoder for this vocabulary file."""
    if path not in _workers:
        _workers[path] = PieceEncoder(path)
    return _workers[path]


def with_end(ids: np.ndarray, first: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Appends end_id to each text's ids."""
    n = len(first) - 1
    out = np.empty(len(ids) + n, ids.dtype)
    to = first + np.arange(n + 1)
    last = np.zeros(len(out), bool)
    last[to[1:] - 1] = True
    out[last] = end_id
    out[~last] = ids
    return out, to
