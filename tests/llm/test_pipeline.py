"""The corpus pipeline against a plain version of its first four stages."""

import collections
import re

from pyspark.sql import functions as F

import corpus_pipeline
from lamella.llm.queries import PASSAGE_BYTES
from lamella.llm.shared import written
from test_llm_operators import covered_runs, in_words


def test_stages_take_odd_rows(spark, small):
    """Null ids, nulls in any column, repeated rows, clashing columns: each stage keeps to what it says."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select(*corpus_pipeline.COLUMNS).limit(60)
    known = docs.where("length(text) > 200").orderBy("doc_id").first()
    leak = spark.read.parquet(f"{small}/benchmark.parquet").where("text is not null").orderBy("item_id").first().text
    odd = [(None, known.text, None, None, None), (None, leak, None, "s", 1), (900_001, None, None, None, None), (900_002, "", "en", None, 0), (900_003, leak, "en", "s", 3), (900_003, leak, "en", "s", 3), (900_004, "12 !!", None, "s", 5)]
    rows = docs.unionByName(docs.where(F.col("doc_id") == known.doc_id)).union(spark.createDataFrame(odd, docs.schema))
    rows = written(rows.withColumn("id", F.lit("x")).withColumn("g", F.lit(1)).withColumn("c0", F.lit(2)).withColumn("__text", F.lit(3)), "odd")
    stages = dict(corpus_pipeline.STAGES)
    names = lambda df: collections.Counter((r.doc_id, r.text) for r in df.collect())
    everything = names(rows)
    out = {name: names(stages[name](spark, rows, small)) for name in ("language", "near_duplicate", "decontaminated")}
    assert all(got <= everything for got in out.values())
    assert out["language"][known.doc_id, known.text] == 2 and out["language"][None, known.text] == 1
    assert not any(i in (900_001, 900_002, 900_004) for i, _ in out["language"])
    assert set(out["near_duplicate"].values()) == {1} and out["near_duplicate"][None, known.text] == 1 and out["near_duplicate"][900_001, None] == 1
    assert (900_003, leak) not in out["decontaminated"] and (None, leak) not in out["decontaminated"] and out["decontaminated"][900_001, None] == 1
    left = stages["repeated_bytes"](spark, rows, small)
    assert left.columns == corpus_pipeline.COLUMNS and left.count() == rows.count()
    assert {r.text for r in left.where("doc_id in (900001, 900002)").collect()} == {""}
    packed = stages["packed"](spark, rows, small)
    assert packed.where("start = 0").count() == rows.count()
    for name in stages:
        assert stages[name](spark, rows.limit(0), small).count() == 0


def test_passages_keep_their_first_copy(spark, small):
    passage = " ".join(f"some{i}" for i in range(51))
    alone = lambda name: " ".join(f"{name}{i}" for i in range(40))
    texts = {1: f"{alone('a')} {passage} {alone('b')}", 2: f"{alone('c')} {passage} {alone('d')}", 3: f"{passage} {alone('e')}", 4: f"{alone('f')} {' '.join(passage.split()[:45])} {alone('g')}"}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_bytes(spark, docs, small).collect()}
    assert got[1] == texts[1] and got[4] == texts[4] and passage not in got[2] + got[3]
    assert got[2].split() == (alone("c") + " " + alone("d")).split() and got[3].split() == alone("e").split()


def test_near_duplicate_tells_texts_of_one_id_apart(spark, small):
    said = lambda name, n=60: " ".join(f"{name}{i}" for i in range(n))
    rows = [(1, said("a")), (2, said("a") + " more"), (2, said("b")), (None, said("c")), (None, said("c") + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text[0]) for r in corpus_pipeline.near_duplicate(spark, docs, small).collect()]
    assert sorted(got, key=str) == [(1, "a"), (2, "b"), (None, "c")]


def test_keys_are_those_of_different_rows(spark, monkeypatch):
    rows = [(1, "a"), (1, "b"), (None, "a"), (None, None), (None, ""), (11, "|a"), (1, "1|a"), (2, None), (2, ""), (1, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for halved in (False, True):
        if halved:  # first halves of four values only, so that rows must be told apart by the second ones
            conv = F.conv
            monkeypatch.setattr(F, "conv", lambda c, a, b: F.pmod(conv(c, a, b).cast("long"), F.when(F.lit("__sha, 1," in str(c)), 4).otherwise(1 << 62)))
        got = corpus_pipeline.keyed(docs, "doc_id", "text").collect()
        by_key = {r["__key"]: (r.doc_id, r.text) for r in got}
        assert len(by_key) == len(set(rows)) and all(by_key[r["__key"]] == (r.doc_id, r.text) for r in got)


def test_stages_and_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, small), name)
        kept[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    first = {r.doc_id: r.text for r in kept["language"].collect()}
    assert len(first) >= 0.97 * spark.read.parquet(f"{small}/documents.parquet").count()
    # near duplicates, one of each group
    low = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    grams = {i: {tuple(w[k : k + 5]) for w in [low(t)] for k in range(max(1, len(w) - 4))} for i, t in first.items()}
    root = {i: i for i in grams}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(grams)
    for a, i in enumerate(ids):
        for j in ids[:a]:
            both = len(grams[i] & grams[j])
            if both and 100 * both >= 75 * (len(grams[i]) + len(grams[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    second = {r.doc_id: r.text for r in kept["near_duplicate"].collect()}
    assert set(second) == {i for i in ids if find(i) == i}
    # repeated passages, but for their first copy
    third = {r.doc_id: r.text for r in kept["repeated_bytes"].collect()}
    rows = sorted(second.items())
    for (i, _), (b, spans) in zip(rows, covered_runs(rows, PASSAGE_BYTES, first_stays=True), strict=True):
        spans = in_words(b, spans, corpus_pipeline.PASSAGE_WORDS)
        assert third[i] == b"".join(b[z:a] for (_, z), (a, _) in zip([(0, 0), *spans], [*spans, (len(b), 0)], strict=True)).decode()
    # benchmark items
    items = [{tuple(w[k : k + 5]) for w in [low(r.text)] for k in range(len(w) - 4)} for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    clean = set()
    for i, t in third.items():
        own = {tuple(w[k : k + 5]) for w in [low(t)] for k in range(len(w) - 4)}
        if not any(s and 100 * len(s & own) >= 75 * len(s) for s in items):
            clean.add(i)
    assert {r.doc_id for r in kept["decontaminated"].collect()} == clean
    packed = kept["packed"]
    assert packed.select("doc_id").distinct().count() == len(clean)
    assert packed.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048
