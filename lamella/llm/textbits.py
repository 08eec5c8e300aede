"""Vectorised text helpers shared by the training-data operators.

Everything here works inside one Arrow batch of a Spark task: Spark deals the
rows, these helpers only turn a column of texts into numpy arrays.  A text that
is null counts as empty.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is one slice alone.
SLICE_BYTES = 2 << 20

#: The six ASCII white-space bytes of the word rule ``[^\x20\x09-\x0D]+``.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_rng = np.random.RandomState(20240607)
#: A random 64-bit value for each byte, and the same with A-Z read as a-z.
BYTE_VALUE = _rng.randint(1, 1 << 63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
LOWER_VALUE = BYTE_VALUE.copy()
LOWER_VALUE[65:91] = BYTE_VALUE[97:123]
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix finaliser)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        low = np.ones(4096, _U)
        low[1:] = _U(base)
        low = np.multiply.accumulate(low)
        rows = -(-n // 4096)
        high = np.ones(rows, _U)
        high[1:] = _U(pow(base, 4096, 1 << 64))
        have = np.multiply.outer(np.multiply.accumulate(high), low).ravel()
        if n <= 2 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and each text's offset."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts each batch into runs of rows with at most ``most`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).cumsum()
        at = 0
        while at < batch.num_rows:
            done = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, done + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and each text's first word (n + 1 entries)."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    solid = ~WHITE[buf]
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    before[offs[:-1][offs[:-1] < len(buf)]] = False
    start = np.flatnonzero(solid & ~before)
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = offs[1:]
    after[ends[ends > 0] - 1] = False
    end = np.flatnonzero(solid & ~after) + 1
    return start, end, np.searchsorted(start, offs)


def span_hashes(buf: np.ndarray, lower: bool = False) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of many spans' starts and ends that gives 64-bit fingerprints of buf[start:end], for spans that
    overlap.  Fingerprints of one value must be told apart by what they name (see ``span_hash``)."""
    n = len(buf)
    sums = np.zeros(n + 1, _U)
    np.cumsum((LOWER_VALUE if lower else BYTE_VALUE)[buf] * powers(_BASE, n), out=sums[1:])

    def of(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = (sums[end] - sums[start]) * powers(_INV, n + 1)[start]
        return mix(value ^ (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))

    return of


#: Spans of more bytes are named by a digest each.
LANE_BYTES = 64
_BYTE = np.arange(256, dtype=np.uint8)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit fingerprint of buf[start:end] for many spans at once, A-Z read as a-z where ``lower``.

    Eight bytes after eight go through ``mix``, which is not linear: sums of byte values times powers
    of a base modulo 2**64 give some words the same value whatever the base is (such as the Thue-Morse
    word of 1,024 letters and its complement).  Spans of over LANE_BYTES take a cryptographic digest.
    """
    n = len(start)
    if not n:
        return np.zeros(0, _U)
    length = end - start
    text = _LOWER[buf] if lower else buf
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(buf) + 1,), "<u8", padded.data, 0, (1,))
    out = mix(length.astype(_U) * _U(0xD6E8FEB86659FD93) + _U(_BASE))
    for j in range(0, min(int(length.max(initial=0)), LANE_BYTES), 8):
        mine = np.flatnonzero((length > j) & (length <= LANE_BYTES)) if j or length.max() > LANE_BYTES else np.flatnonzero(length > 0)
        if not len(mine):
            break
        lane = np.take(lanes, start[mine] + j)
        short = length[mine] - j
        tail = short < 8
        lane[tail] &= (_U(1) << (short[tail].astype(_U) * _U(8))) - _U(1)
        out[mine] = mix((out[mine] ^ lane) + _U(_BASE))
    wide = np.flatnonzero(length > LANE_BYTES)
    if len(wide):
        raw = memoryview(np.ascontiguousarray(text))
        named = b"".join(hashlib.blake2b(raw[a:z], digest_size=8).digest() for a, z in zip(start[wide].tolist(), end[wide].tolist(), strict=True))
        out[wide] = np.frombuffer(named, "<u8")
    return out


def word_hashes(buf: np.ndarray, offs: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit fingerprint of every word, and each text's first word."""
    start, end, first = words(buf, offs)
    return span_hash(buf, start, end, lower), first


def gram_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """A fingerprint of each n consecutive values (by doubling); len - n + 1 entries."""
    if len(values) < n:
        return np.zeros(0, _U)
    base = 0xD1342543DE82EF95
    have, size, block, block_size, rest = None, 0, values, 1, n
    while rest:
        if rest & 1:
            if have is None:
                have, size = block, block_size
            else:  # what is gathered so far stands left of the next block
                m = len(values) - size - block_size + 1
                have = have[:m] * _U(pow(base, block_size, 1 << 64)) + block[size : size + m]
                size += block_size
        rest >>= 1
        if rest:
            m = len(block) - block_size
            block = block[:m] * _U(pow(base, block_size, 1 << 64)) + block[block_size : block_size + m]
            block_size *= 2
    return mix(have[: len(values) - n + 1])


def starts_of(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a run of n values lies in one text, and each text's first of them."""
    count = np.maximum(np.diff(first) - n + 1, 0)
    to = np.concatenate([[0], count.cumsum()])
    return ranges(first[:-1], count), to


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, .. (count[0] of them), start[1], .."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    to = count.cumsum()
    return np.arange(total, dtype=np.int64) + np.repeat(start - (to - count), count)


def shingles(hashes: np.ndarray, first: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the n-word shingles of each text, repeats included, and each
    text's first one.  A text of 1 to n-1 words has one: its whole sequence."""
    at, to = starts_of(first, n)
    grams = gram_hashes(hashes, n)[at]
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < n))
    if not len(short):
        return grams, to
    size = np.diff(to)
    size[short] = 1
    full = np.concatenate([[0], size.cumsum()])
    out = np.empty(full[-1], _U)
    keep = np.ones(len(out), bool)
    keep[full[short]] = False
    out[keep] = grams
    for k in range(1, n):
        mine = short[count[short] == k]
        if len(mine):
            out[full[mine]] = mix(gram_hashes(hashes, k)[first[mine]] + _U(k))
    return out, full


def distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text, ascending, and each text's first one."""
    if not len(values):
        return values, np.zeros(len(first), np.int64)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((values, owner)) if len(first) > 2 else np.argsort(values)
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(first)))


def unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs (a[i], b[i]) in their order: the first place of each, which pair each place has, and how often each stands."""
    order = np.lexsort((b, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    return order[new], kind, np.bincount(kind, minlength=int(new.sum()))


def segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of values[first[i]:first[i+1]] for each i (0 where empty)."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[first[1:]] - sums[first[:-1]]


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie in [s, s + length) for some s."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:-1]) > 0


def crc32_ids(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
