"""Helpers against their plain versions."""

import itertools
import re

import numpy as np
import pyarrow as pa
import pytest

from lamella.llm import textbits as tb
from lamella.llm import token_store, tokens
from lamella.llm.ballots import repeated
from lamella.llm.packing import combinations, least_squares, plan
from lamella.llm.quality_rules import suffix_array
from lamella.llm.queries import vocabulary
from lamella.llm.substring_dedup import digests, recompress
from lamella.llm.suffix_dedup import intervals, judge_contexts, sliding_least

TEXTS = ["a b\tc  d e f", "", None, "x", "Hello  World é à\nfoo bar baz qux", " ", "a b c d e f a b c d e f", "\x0b\x0cz\r", "日本 語\n語"]
ODD = ["", "  a  b \n\n c\n d's 'll  é   x　 y\n", "<|endoftext|> a <|endoftext|>b <|ENDOFTEXT|>", "á b ́c ≠ a≠", "tab\t x\r\n y", " lead", "trail ", "x\n", "\n", "日本 語\n語 テ", "ΣΑΣ ΣΑΣ\nΣ", "a   b \nc", "it's 'S 'T we'Ll 123 45\n6!! ?? \n?", "a,b;c''s x'd 'd,'d×ab÷c é,é ß.ß", "İ I i̇ K", "0 a0b 00", "First paragraph.\n\nSecond paragraph.", "a\n\na", "\n\nStart", "a,\n\n- b", "x\r\n\r\ny", "a\n\n"]


def test_words_are_those_of_the_rule():
    buf, offs = tb.text_buffer(pa.array(TEXTS))
    start, end, first = tb.words(buf, offs)
    raw = buf.tobytes()
    got = [[raw[start[i] : end[i]].decode() for i in range(first[k], first[k + 1])] for k in range(len(TEXTS))]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in TEXTS]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 8, 20])
def test_gram_hashes_tell_grams_apart(n):
    values = tb.mix(np.arange(50, dtype=np.uint64) % np.uint64(10))
    grams = tb.gram_hashes(values, n)
    assert len(grams) == 51 - n and len(set(grams.tolist())) == min(10, len(grams)) and (grams[:-10] == grams[10:]).all()


def test_sliced_columns_and_slices():
    column = pa.array(TEXTS).slice(3, 4)
    buf, offs = tb.text_buffer(column)
    assert buf.tobytes() == "".join(t or "" for t in TEXTS[3:7]).encode() and len(offs) == 5
    batch = pa.record_batch({"text": pa.array(["ab"] * 10)})
    assert [b.num_rows for b in tb.slices([batch], most=5)] == [2] * 5
    assert [b.num_rows for b in tb.slices([batch], most=1)] == [1] * 10


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_encode_like_whole_texts(name):
    from tokenizers import Tokenizer

    path = vocabulary(name)
    plain, mine = Tokenizer.from_file(path), tokens.PieceEncoder(path)
    for texts in [ODD, *[[x] for x in ODD], ODD]:
        ids, first = mine.encode(*tb.text_buffer(pa.array(texts)))
        for i, x in enumerate(texts):
            assert ids[first[i] : first[i + 1]].tolist() == plain.encode(x, add_special_tokens=False).ids, x


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("symbols", [["a", "S", " ", "\n", "\t", "'", ".", "1", "é", "\u3000"], ["t", " ", "\n", "\r", "\u0301", "\x0b", "\u2028", "語", "<|endoftext|>", "!"]])
def test_all_short_strings_encode_like_the_library(name, symbols):
    from tokenizers import Tokenizer

    path = vocabulary(name)
    plain, mine = Tokenizer.from_file(path), tokens.PieceEncoder(path)
    for n in range(1, 6):
        texts = ["".join(x) for x in itertools.product(symbols, repeat=n)]
        ids, first = mine.encode(*tb.text_buffer(pa.array(texts)))
        for i, want in enumerate(plain.encode_batch_fast(texts, add_special_tokens=False)):
            assert ids[first[i] : first[i + 1]].tolist() == want.ids, repr(texts[i])


def thue_morse(n, letters="ab"):
    """Two words whose polynomial hashes modulo 2**64 are equal, whatever the base."""
    return tuple("".join(letters[(bin(k).count("1") + f) % 2] for k in range(n)) for f in (0, 1))


@pytest.mark.parametrize("n", [3, 8, 9, 32, 64, 65, 1024, 4096])
def test_words_of_the_thue_morse_kind_have_their_own_fingerprints(n):
    for lower in (False, True):
        for letters in ("ab", "é語"):
            buf, offs = tb.text_buffer(pa.array([" ".join(thue_morse(n, letters))]))
            assert len(set(tb.word_hashes(buf, offs, lower)[0].tolist())) == 2
    buf, offs = tb.text_buffer(pa.array(["Ab" * n, "aB" * n]))
    assert len(set(tb.word_hashes(buf, offs, True)[0].tolist())) == 1 and len(set(tb.word_hashes(buf, offs)[0].tolist())) == 2


def test_fingerprints_tell_all_short_words_apart():
    words = ["".join(x) for n in range(1, 5) for x in itertools.product("ab\x00é1", repeat=n)]
    buf, offs = tb.text_buffer(pa.array(words))
    assert len(set(tb.span_hash(buf, offs[:-1], offs[1:]).tolist())) == len(words)
    both, edge = tb.text_buffer(pa.array([f"..{w}!" for w in words]))
    assert (tb.span_hash(both, edge[:-1] + 2, edge[1:] - 1) == tb.span_hash(buf, offs[:-1], offs[1:])).all()


@pytest.mark.parametrize("counts", [[1, 1, 1, 1_000_000], [5] * 49_000, [0, 7], [3, 0, 2], list(range(1, 3000))])
def test_huffman_round_trip(counts):
    counts = np.array(counts)
    lengths = token_store.code_lengths(counts)
    assert lengths.max() <= token_store.LONGEST and (lengths[counts == 0] == 0).all()
    ids = np.random.RandomState(1).choice(np.flatnonzero(counts), 3000).astype(np.uint32)
    bits, marks = token_store.pack_bits(ids, lengths, token_store.canonical(lengths))
    assert (token_store.unpack_bits(bits, marks, len(ids), lengths) == ids).all()
    assert len(marks) == -(-len(ids) // token_store.CHECKPOINT)
    assert (token_store.unpack_bits(bits, marks, 5, lengths) == ids[:5]).all() if len(marks) == 1 else True


def test_code_lengths_are_optimal_when_the_limit_is_loose():
    import heapq

    counts = np.random.RandomState(2).randint(1, 1000, 200)
    heap = [(int(c), i, 0) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    cost, k = 0, len(counts)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a[0] + b[0]
        k += 1
        heapq.heappush(heap, (a[0] + b[0], k, 0))
    assert (token_store.code_lengths(counts, 30) * counts).sum() == cost


def test_recompression_names_depend_on_their_context_only():
    rng = np.random.RandomState(3)
    passage = rng.randint(0, 50, 30)
    a = np.concatenate([rng.randint(0, 50, 17), passage, rng.randint(0, 50, 9)])
    b = np.concatenate([rng.randint(0, 50, 4), passage, rng.randint(0, 50, 23)])
    both = tb.mix(np.concatenate([a, b]).astype(np.uint64))
    names, left, right = recompress(both, np.array([0, len(a), len(a) + len(b)]))
    inside = lambda lo: {(int(x) - lo, int(y) - lo, int(n)) for x, y, n in zip(left, right, names, strict=True) if x >= lo and y <= lo + 30}
    assert inside(17) == inside(len(a) + 4) and inside(17)


def test_every_window_holds_a_whole_context():
    values = tb.mix(np.random.RandomState(4).randint(0, 10_000, 2000).astype(np.uint64))
    _, left, right = recompress(values, np.array([0, 2000]))
    for at in range(1, 1970):
        assert ((left >= at) & (right <= at + 20)).any()


def test_intervals_of_a_small_array():
    assert sorted(intervals(np.array([1, 3, 1, 0]))) == [(0, 0, 4), (1, 0, 3), (3, 1, 2)]


def test_sliding_least():
    v = np.random.RandomState(5).randint(0, 99, 200)
    for w in (1, 2, 7, 64, 100):
        assert (sliding_least(v, w) == [v[i : i + w].min() for i in range(201 - w)]).all()


def test_suffix_array_prefixes():
    text = [1, 2, 3, 4, 5, 9, 1, 2, 3, 4, 5, 6, 1, 2, 3, 4]
    place, lcp = suffix_array(tb.mix(np.array(text, np.uint64)), np.array([0, len(text)]), 3)
    for i in range(len(place) - 1):
        a, b = place[i], place[i + 1]
        k = 0
        while max(a, b) + k < len(text) and text[a + k] == text[b + k]:
            k += 1
        assert lcp[i] == (k if k >= 3 else 0)
    assert {0, 1, 2, 6, 7, 8, 12, 13} <= set(place.tolist())


@pytest.mark.parametrize("seed", range(20))
def test_suffix_array_finds_the_longest_repeat(seed):
    rng = np.random.RandomState(seed)
    text = rng.randint(0, 4, 120)
    place, lcp = suffix_array(tb.mix(text.astype(np.uint64) + np.uint64(seed)), np.array([0, 120]), 3)
    best = {}
    for i in range(120):
        for j in range(120):
            k = 0
            while i != j and max(i, j) + k < 120 and text[i + k] == text[j + k]:
                k += 1
            best[i] = max(best.get(i, 0), k)
    reach = dict(zip(place.tolist(), np.maximum(np.append(lcp, 0), np.append(0, lcp)).tolist(), strict=True))
    assert all(reach.get(i, 0) == (k if k >= 3 else 0) for i, k in best.items())


def test_repeated():
    assert repeated(np.array([3, 1, 3, 2])).tolist() == [True, False, True, False] and not len(repeated(np.zeros(0)))


def test_packing_plan_uses_no_length_too_often():
    rng = np.random.RandomState(6)
    for hist in (rng.poisson(30, 65), np.eye(65, dtype=int)[40] * 1000, np.zeros(65, int)):
        hist[0] = 0
        combos, repeat = plan(hist, 64)
        used = np.zeros(65, int)
        for c, r in zip(combos, repeat, strict=True):
            assert c.sum() == 64
            np.add.at(used, c[c > 0], r)
        assert (used <= hist).all()
    assert len(combinations(np.arange(1, 9), 8, 3)) == 10  # partitions of 8 into at most three parts
    assert (least_squares(combinations(np.array([3, 5]), 8, 2), np.array([0, 0, 0, 10, 0, 10, 0, 0, 0], float)) > 9.9).all()


def test_digests_are_those_of_the_words():
    words = ["ab", "c", "ab", "c", "abc"]
    line, ends = "".join(w + " " for w in words).encode(), np.cumsum([len(w) + 1 for w in words])
    name, check = digests(line, ends, np.array([0, 2, 1, 3]), 2)
    assert name[0] == name[1] and check[0] == check[1] and len(set(name.tolist())) == len(set(check.tolist())) == 3


def test_pairs_that_share_a_half_stay_apart():
    a, b = np.array([1, 1, 2, 1, 2], np.uint64), np.array([5, 6, 5, 5, 5], np.uint64)
    first, kind, held = tb.unique_pairs(a, b)
    assert first.tolist() == [0, 1, 2] and kind.tolist() == [0, 1, 2, 0, 2] and held.tolist() == [2, 1, 2]
    assert [x.tolist() for x in tb.unique_pairs(a[:0], b[:0])] == [[], [], []]
    said = judge_contexts(a, b, np.zeros(5, np.int64), np.array([3, 3, 3, 4, 4]))
    assert said.tolist() == [1, 0, 1, 2, 2]  # the first, alone, the first, after, after
