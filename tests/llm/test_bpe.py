"""Tree concatenation against the library's own encoding of whole texts."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.llm.bpe import bpe_decode, bpe_digests, bpe_encode, join, segments, words
from lamella.llm.queries import QUERIES, vocabulary
from lamella.llm.tokens import encoder

PATH = vocabulary("byte_bpe_50k.json")
LONG = [
    "a" * 3000, "ab" * 1500, "xyz" * 901, "0123456789" * 200, " " * 2000 + "x", "\n" * 1500, "a" + "\t " * 700 + "b c", "!?" * 900, "'" * 801 + "s and 's", "日本語" * 500, "日" * 999 + "。", "🙂" * 600, "👩‍👩‍👧" * 300,
    "thequickbrownfoxjumpsoverthelazydog" * 60, "x" * 300 + "<|endoftext|>" + "y" * 300, "<|endoftext|>" * 120, "a <|endoftext|> b " * 90, "word " * 500, "it's we're 'll don't " * 80, "é̂" * 700, "first.\n\nSecond.\n\n\n" * 90,
    " " * 100 + "z" * 700 + "'re" + " " * 300, "　" * 400 + "語" * 500, "A1b2C3d4" * 200,
]


def whole(text):
    return encoder(PATH).tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("size", [64, 100, 257])
def test_segments_join_to_the_encoding_of_the_whole(spark, size):
    rng = random.Random(5)
    letters = ["".join(rng.choice("etaoinshrdlu") for _ in range(2000)), "".join(rng.choice("ab") for _ in range(1500)), "".join(rng.choice("aé語 .'\n\ts1") for _ in range(1500))]
    rows = [*enumerate(LONG + letters), (None, "q" * 500), (7, "q" * 500), (7, "q" * 500), (900, None), (901, ""), (902, "short text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("x")).withColumn("row", F.lit(1)).withColumn("ids", F.lit(2))
    parts = bpe_encode(docs, PATH, segment=size).collect()
    got = {}
    for r in sorted(parts, key=lambda r: (r["row"] or "", r["part"])):
        got.setdefault((r["doc_id"], r["row"]), []).extend(r["ids"])
    want = sorted((-1 if i is None else i, whole(t)) for i, t in rows if len(t or "") > size)
    assert sorted((-1 if i is None else i, x) for (i, row), x in got.items() if row) == want
    assert sum(1 for r in parts if r["row"]) > len(want)
    told = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe_digests(docs, PATH, segment=size).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert told == sorted((-1 if i is None else i, len(whole(t)), sha(",".join(map(str, whole(t)))), sha(t or "")) for i, t in rows)


def test_cuts_lie_in_pretokens_only_where_there_is_no_other_place():
    tok = encoder(PATH).tokenizer
    assert all(not inside for _, inside in segments("some words, and 12 more. " * 50, tok, 64))
    assert any(inside for _, inside in segments("a" * 500, tok, 64))
    text = "<|endoftext|>" * 60
    assert all(at % 13 == 0 for at, _ in segments(text, tok, 64))


@pytest.mark.parametrize("alphabet", ["a", "ab", "aeinst", "0123456789", " \n", "日本語", "=-_"])
def test_windows_grow_until_both_sides_agree(alphabet):
    rng = random.Random(alphabet)
    for n in (2, 9, 60, 400):
        for _ in range(25):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            at = rng.randrange(1, n)
            left, right = (np.array(whole(x), np.uint32) for x in (text[:at], text[at:]))
            ids, before, after = join(left, len(left), right, len(right), PATH, window=1)
            assert ids.tolist() == whole(text) and (before, after) == (0, 0)


def test_decode_is_the_library_s(spark):
    rng = random.Random(1)
    rows = [(k, [rng.randrange(50257) for _ in range(30)]) for k in range(200)] + [(200, []), (201, None), (202, [50256, 11, -5, 99_999])]
    got = {r.doc_id: r.text for r in bpe_decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), PATH).collect()}
    tok = encoder(PATH).tokenizer
    for k, ids in rows[:201]:
        assert got[k] == tok.decode(ids, skip_special_tokens=False)
    assert got[201] == "" and got[202] == "<|endoftext|>,"
    assert len(words(PATH).length) == 50257


def test_query_gives_the_library_s_ids_of_all_documents(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op11_tree_bpe"](spark, small).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = whole(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(encoder(PATH).tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_encode(docs, PATH).count() == 0 and bpe_digests(docs, PATH).count() == 0
