"""The ten operators against brute-force versions, on the small tables and on edge cases."""

import collections
import hashlib
import re
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.llm import ballots, components, shared
from lamella.llm.decontaminate import ItemBlock, contained_items
from lamella.llm.language_id import BUCKETS, PRIOR, fit_on, identify
from lamella.llm.license_scan import NAMES, RULES, Known, SENTENCES, license_scan, normalise, split_sentences
from lamella.llm.near_dedup import near_duplicates
from lamella.llm.packing import pack
from lamella.llm.quality_rules import quality_rules
from lamella.llm.queries import QUERIES, vocabulary
from lamella.llm.shared import shared_folder, split_join
from lamella.llm.sharding import balanced_shards
from lamella.llm.substring_dedup import substring_dedup
from lamella.llm.suffix_dedup import repeat_groups, suffix_dedup
from lamella.llm.textbits import mix
from lamella.llm.token_store import read_ids, write_ids

WORDS = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
LOWER = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
CLASHING = "g long, id long, x long, p long, key string, n long, part int, shard int, bin int, count long, component long"


def edge_rows(spark):
    long = " ".join(f"w{i * i % 977}" for i in range(30_000))
    passage = " ".join(f"passage{i}" for i in range(70))
    rows = [
        (None, "no id here at all"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Two words"), (6, "two WORDS"), (7, long), (8, "x " * 5000), (9, "a" * 3000), (10, passage), (11, "before " + passage + " after"),
        (12, passage), (12, passage), (13, "é" * 700), (14, "z " + "é" * 700), (15, "same text of six words here"), (16, "same text of six words here"), (17, "Released under the MIT License.\nbye"), (18, "12345 !!"),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    extra = [F.lit(1).cast(c.split()[1]).alias(c.split()[0]) for c in CLASHING.split(", ")]
    return docs.select("*", *extra)


def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(autouse=True)
def many_groups(monkeypatch):
    """Small tables are dealt into several groups and buckets too."""
    monkeypatch.setattr(ballots, "LEAST_GROUP_BYTES", 20_000)
    monkeypatch.setattr(ballots, "LEAST_BUCKET_BYTES", 60_000)


def test_ballots_follow_the_bytes_of_text(monkeypatch):
    monkeypatch.undo()
    for size, tasks in ((0, 4), (50_000_000, 211), (1 << 30, 200), (1 << 40, 2000), (10**14, 10_000)):
        groups, buckets = ballots.dealing(size, tasks)
        assert groups >= 1 <= buckets and (groups == 1 or size / groups > 40_000) and groups * buckets < 50 + size / 500
        assert size / buckets <= ballots.BUCKET_BYTES and size / groups <= max(ballots.GROUP_BYTES, 256 << 20)


@pytest.fixture(params=["small", "edge"])
def docs(request, spark, small):
    return documents(spark, small) if request.param == "small" else edge_rows(spark)


def pairs_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_near_duplicates(docs):
    rows = pairs_of(docs)
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    sets = {}
    for i, t in rows:
        w = WORDS(LOWER(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(i for i in sets if i is not None)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, i in enumerate(ids):
        for j in ids[:a]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)


def test_near_duplicates_across_components(spark):
    """A chain whose ends do not link, and copies that are near no pivot."""
    base = [f"t{i}" for i in range(60)]
    texts = []
    for k in range(40):
        w = list(base)
        for j in range(k):
            w[(j * 7) % 60 - 1] = f"k{j}"
        texts.append((k, " ".join(w)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    test_near_duplicates(docs)


@pytest.fixture
def every_join_splits(monkeypatch):
    monkeypatch.setattr(shared, "FEW_ROWS", 0)
    monkeypatch.setattr(components, "FEW_EDGES", 0)


def test_near_duplicates_of_a_hot_circle(spark, every_join_splits):
    """Over 1,000 texts in one circle: a third exact copies, a third near ones, a third that only share half keys."""
    base = [f"t{i}" for i in range(40)]
    rows = [(i, " ".join(base)) for i in range(400)]
    rows += [(i, " ".join([*base, f"n{i}"])) for i in range(400, 900)]
    rows += [(i, " ".join([*base, *(f"far{i % 30} {k}" for k in range(10)), f"m{i % 90}"])) for i in range(900, 1300)]
    test_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))


def test_split_joins_keep_all_rows(spark, every_join_splits):
    big = spark.range(6000).select((F.col("id") % 7 * (F.col("id") % 3)).alias("k"), F.col("id").alias("v"))
    per_key = big.groupBy("k").agg(F.max("v").alias("m"), F.count("*").alias("__n")).where("k > 0")
    got = split_join(big, per_key, ["k"], 6000, ["v"])
    assert sorted(map(tuple, got.select("k", "v", "m").collect())) == sorted(map(tuple, big.join(per_key, "k").select("k", "v", "m").collect()))
    assert got.select("v").distinct().count() == got.count()


def test_quality_rules(docs):
    got = quality_rules(docs).collect()
    rows = collections.Counter(pairs_of(docs))
    assert len(got) == sum(rows.values())
    by_id = {r.doc_id: r for r in got}
    for i, t in rows:
        t = t or ""
        w, r = WORDS(t), by_id[i]
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORDS(line):
                dup += line in seen
                seen.add(line)
        windows = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        again = set()
        for k in range(len(w) - 7):
            if windows[tuple(w[k : k + 8])] > 1:
                again |= set(range(k, k + 8))
        failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again), failed)
        assert r.kept in ((False,) if failed else (True, False))
        if len(w) < 1500:
            places = collections.defaultdict(list)
            for k in range(len(w) - 5):
                places[tuple(w[k : k + 6])].append(k)
            cover, longest = set(), 0
            for p in places.values():
                for a in range(len(p)):
                    for b in range(a + 1, len(p)):
                        k = 0
                        while p[b] + k < len(w) and w[p[a] + k] == w[p[b] + k]:
                            k += 1
                        longest = max(longest, k)
                        cover |= set(range(p[a], p[a] + k)) | set(range(p[b], p[b] + k))
            assert (r.n_covered, r.longest_repeat) == (len(cover), longest)


def test_quality_rules_fail_long_repeats(spark):
    half = " ".join(f"r{i}" for i in range(60))
    clean = " ".join(f"c{i}" for i in range(400))
    docs = spark.createDataFrame([(1, f"{half} {half} " + " ".join(f"o{i}" for i in range(60))), (2, clean)], "doc_id long, text string")
    rows = {r.doc_id: r for r in quality_rules(docs).collect()}
    assert not rows[1].kept and rows[1].longest_repeat == 60 and rows[1].n_repeats == 1 and rows[2].kept and rows[2].n_repeats == 0


def test_license_scan(docs):
    known = Known(SENTENCES)
    by_id = {r.doc_id: r for r in license_scan(docs).collect()}
    for i, t in pairs_of(docs):
        want = [known[normalise(s)] for s in split_sentences(t or "") if normalise(s) in known]
        assert by_id[i].sentence_ids == want and by_id[i].n_known_sentences == len(want)


def test_license_rules_in_order(spark):
    text = {name: said.replace("<...>", "the copyright holder") for name, said in SENTENCES}
    mit = "\n".join(text[k] for k in ("mit-grant", "mit-notice", "mit-warranty"))
    docs = spark.createDataFrame([(1, "MIT License\n\n" + mit), (2, text["mit-warranty"]), (3, text["bsd-grant"] + " * " + text["bsd-source"] + "\n" + text["bsd-binary"] + " " + text["bsd-endorse"]), (4, "See the GNU General Public License for more details."), (5, "Licensed under CC BY-NC 4.0. And more.")], "doc_id long, text string")
    rows = {r.doc_id: r for r in license_scan(docs).collect()}
    assert rows[1].licenses == ["MIT"] and len(rows[1].matches) == 1 and not rows[1].restricted
    assert rows[2].licenses == [] and rows[2].n_known_sentences == 1
    assert rows[4].licenses == [] and rows[5].licenses == ["CC-BY-NC-4.0"] and rows[5].restricted


@pytest.mark.parametrize("mark", ["", " * ", "# ", "// "])
def test_license_headers_wrapped_over_lines(spark, mark):
    text = {name: said.replace("<...>", "the copyright holder") for name, said in SENTENCES}
    said = lambda *names: " ".join(text[k] for k in names)
    headers = [
        ("GPL-3.0-or-later", [said("gpl-grant"), said("gpl-hope", "gpl-see")]),
        ("GPL-2.0-or-later", [said("gpl2-grant"), said("gpl-hope", "gpl-see")]),
        ("BSD-2-Clause", [said("bsd-grant"), "1. " + said("bsd-source"), "2. " + said("bsd-binary")]),
        ("BSD-3-Clause", [said("bsd-grant"), "a) " + said("bsd-source"), "b) " + said("bsd-binary"), "c) " + said("bsd-endorse")]),
        ("MIT", ["Copyright (c) 2020 Someone", said("mit-grant"), said("mit-notice"), said("mit-warranty")]),
        ("Apache-2.0", [said("apache2-grant", "apache2-comply", "apache2-copy"), "http://www.apache.org/licenses/LICENSE-2.0", said("apache2-warranty", "apache2-see")]),
    ]
    rows = [(i, "\n".join(mark + x for paragraph in paragraphs for x in [*textwrap.wrap(paragraph, 72), ""])) for i, (_, paragraphs) in enumerate(headers)]
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (licence, _) in enumerate(headers):
        assert got[i].licenses == [licence] and len(got[i].matches) == 1 and got[i].restricted == licence.startswith("GPL")
        assert got[i].n_known_sentences == [3, 3, 3, 4, 3, 5][i]


@pytest.mark.parametrize("width", [None, 72, 80])
@pytest.mark.parametrize("mark", ["", "# ", "// ", " * "])
def test_license_texts_of_many_licences(spark, width, mark):
    """Each licence is found as one paragraph, wrapped, and behind comment marks; so are one-line notices."""
    text = collections.defaultdict(list)
    for name, said in SENTENCES:
        text[name].append(said)
    wanted = {licence: need for licence, _, need in reversed(RULES) if not need[0].startswith("line:")}
    rows = [(licence, " ".join(text[k][0].replace("<...>", "the copyright holder") for k in need)) for licence, need in wanted.items()]
    rows += [(licence, line) for licence, _, names in NAMES for line in [f"SPDX-License-Identifier: {licence}", *names[:1]]]
    rows += [("MPL-2.0", "Licensed under the Mozilla Public License 2.0."), ("LGPL-2.1-only", "This project is licensed under the GNU Lesser General Public License v2.1.")]
    wrap = lambda t: textwrap.wrap(t, width) if width else [t]
    docs = spark.createDataFrame([(i, "\n".join(mark + x for x in wrap(t))) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in license_scan(docs).collect()}
    assert [(rows[i], got[i]) for i in range(len(rows)) if got[i] != [rows[i][0]]] == []
    assert len({licence for licence, _ in rows}) >= 50


@pytest.mark.parametrize("holder", ["the copyright holder", "Google Inc.", "Example University, its Regents", "<ORGANIZATION>", "A. B. van der Holder & Co"])
def test_license_names_have_open_places(spark, holder):
    text = collections.defaultdict(list)
    for name, said in SENTENCES:
        text[name].append(said)
    body = [text[k][0] for k in ("bsd-grant", "bsd-source", "bsd-binary")]
    end = "to endorse or promote products derived from this software without specific prior written permission."
    rows = [
        (1, [f"Neither the name of {holder} nor the names of its contributors may be used {end}"], "BSD-3-Clause"), (2, [f"The name of {holder} may not be used {end}"], "BSD-3-Clause"),
        (3, [f"Neither the name of {holder} nor the names of contributors may be used {end}"], "BSD-3-Clause"), (4, [], "BSD-2-Clause"), (5, [f"Neither the name of {'x ' * 40} nor the names of its contributors may be used {end}"], "BSD-2-Clause"),
    ]
    docs = spark.createDataFrame([(i, "\n".join(textwrap.wrap(" ".join(body + more), 70))) for i, more, _ in rows], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in license_scan(docs).collect()}
    assert got == {i: [want] for i, _, want in rows}


THUE_MORSE = ["".join("ab"[(bin(k).count("1") + f) % 2] for k in range(1024)) for f in (0, 1)]


def test_words_that_polynomial_hashes_confuse(spark):
    """A Thue-Morse word and its complement, alone, among equal words, as lines and as whole texts."""
    a, b = THUE_MORSE
    said = " ".join(f"w{i}" for i in range(19))
    rows = [(1, a), (2, b), (3, f"{said} {a}"), (4, f"{said} {b}"), (5, f"{a}\n{b}"), (6, f"{a}\n{a}"), (7, f"{said} {a} end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    assert near[1] == 1 and near[2] == 2
    lines = {r.doc_id: r.n_dup_lines for r in quality_rules(docs).collect()}
    assert lines[5] == 0 and lines[6] == 1
    gone = {r.doc_id: r.n_removed for r in substring_dedup(docs).collect()}
    assert gone[4] == 0 and gone[7] == 20 and gone[3] == 0
    leaks = contained_items(docs, spark.createDataFrame([(1, f"{said} {a}")], "item_id long, text string"))
    assert {(r.doc_id, r.n_shared) for r in leaks.collect()} == {(3, 16), (7, 16), (4, 15)}


@pytest.mark.parametrize("bits", [0, 12])
def test_names_that_share_a_half_are_told_apart(docs, bits):
    plain = lambda df: sorted((r.doc_id or -1, r.n_removed, r.kept_sha256) for r in df.collect())
    assert plain(substring_dedup(docs, name_bits=bits)) == plain(substring_dedup(docs))
    for rule in ({}, {"first_stays": True, "split_above": 2}):
        assert plain(suffix_dedup(docs, name_bits=bits, **rule)) == plain(suffix_dedup(docs, **rule))


def test_near_duplicates_of_an_id_on_several_texts(spark):
    said = lambda name, n=60: " ".join(f"{name}{i}" for i in range(n))
    rows = [(1, said("a")), (1, said("b")), (2, said("a") + " x"), (3, said("b") + " y"), (4, said("c")), (4, said("d")), (5, said("d") + " z"), (6, said("e"))]
    for order in (rows, rows[::-1]):
        got = {(r.doc_id, r.component_id) for r in near_duplicates(spark.createDataFrame(order, "doc_id long, text string")).collect()}
        assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)}


def test_substring_dedup_of_one_id_on_many_texts(spark):
    said = lambda name: " ".join(f"{name}{i}" for i in range(30))
    rows = [(7, f"{said('same')} {said(f't{k}')}") for k in range(40)] + [(1, said("own"))]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.n_removed for r in got) == [0, 0] + [30] * 39


def test_substring_dedup(docs):
    rows = sorted(pairs_of(docs), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    got = collections.defaultdict(list)
    for r in substring_dedup(docs).collect():
        got[r.doc_id].append((r.n_words, r.n_removed, r.kept_sha256, r.kept_text))
    seen, want = set(), collections.defaultdict(list)
    for i, t in rows:
        w = WORDS(t)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[i].append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def covered_runs(rows, window, first_stays=False):
    """Runs of bytes of each text that strings of ``window`` bytes found elsewhere (or earlier) cover."""
    count, seen, out = collections.Counter(), set(), []
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[k : k + window] for k in range(len(b) - window + 1))
    for _, t in rows:
        b = (t or "").encode()
        gone, end = bytearray(len(b)), 0
        for k in range(len(b) - window + 1):
            s = b[k : k + window]
            if s in seen if first_stays else count[s] > 1:
                a = max(k, end)
                gone[a : k + window] = b"\1" * (k + window - a)
                end = k + window
            if first_stays:
                seen.add(s)
        out.append((b, [m.span() for m in re.finditer(b"\1+", bytes(gone))]))
    return out


def in_words(text, spans, least):
    """The spans that hold that many whole words, cut to them."""
    words, out = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)], []
    for a, z in spans:
        mine = [w for w in words if a <= w[0] and w[1] <= z]
        if len(mine) >= max(least, 1):
            out.append((mine[0][0], mine[-1][1]))
    return out


@pytest.mark.parametrize("split_above", [2000, 0, 3])
@pytest.mark.parametrize("first_stays, least_words", [(False, 0), (True, 0), (True, 12)])
def test_suffix_dedup(docs, split_above, first_stays, least_words):
    rows = sorted(pairs_of(docs), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    want = collections.Counter()
    for (i, _), (b, spans), (_, shorter) in zip(rows, covered_runs(rows, 400, first_stays), covered_runs(rows, 100), strict=True):
        spans = in_words(b, spans, least_words) if least_words else spans
        passages = in_words(b, shorter, 15)
        kept = b"".join(b[z:a] for (_, z), (a, _) in zip([(0, 0), *spans], [*spans, (len(b), 0)], strict=True))
        want[i, len(b), len(b) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), len(passages), sum(z - a for a, z in passages)] += 1
    got = suffix_dedup(docs, first_stays=first_stays, least_words=least_words, passage=100, passage_words=15, split_above=split_above).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passages, r.n_passage_bytes) for r in got) == want
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and len(r.kept_text.encode()) >= r.n_bytes - r.n_removed


@pytest.mark.parametrize("split_above", [2000, 0, 3])
@pytest.mark.parametrize("first_stays", [False, True])
def test_suffix_dedup_of_edited_copies(spark, split_above, first_stays):
    """Repeats whose ends lie anywhere around the anchors."""
    rng = np.random.RandomState(8)
    base = "".join(chr(97 + c) for c in rng.randint(0, 26, 1500))
    rows = [(0, base)]
    for k in range(1, 30):
        a, z = sorted(rng.randint(0, 1500, 2))
        rows.append((k, "".join(chr(65 + c) for c in rng.randint(0, 26, 60)) + base[a:z] + "".join(chr(65 + c) for c in rng.randint(0, 26, 60))))
    test_suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), split_above, first_stays, 0)


def test_repeat_groups_have_all_occurrences(spark):
    rng = np.random.RandomState(3)
    base = "".join(chr(97 + c) for c in rng.randint(0, 26, 700))
    texts = {0: base, 1: base, 2: "", 3: None, 4: "x" * 300, 5: base[:400] + base[300:]}
    for k in range(6, 30):
        a, z = sorted(rng.randint(0, 700, 2))
        texts[k] = f"<{k}>" + base[a:z] + f"({k})"
    got = collections.defaultdict(set)
    for r in repeat_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), window=100).collect():
        got[r.repeat_id, r.n_bytes].add((r.doc_id, r.start))
    strings = {}
    for (name, n), places in got.items():
        said = {texts[i][a : a + n] for i, a in places}
        assert len(said) == 1 and len(places) > 1 and n >= 100
        strings[name, n] = said.pop()
    where = collections.defaultdict(set)
    for i, t in texts.items():
        for k in range(len(t or "") - 99):
            where[t[k : k + 100]].add((i, k))
    for w, places in where.items():
        if len(places) > 1:
            assert any(all((i, k - o) in got[g] for i, k in places) for g, t in strings.items() for o in [m.start() for m in re.finditer(f"(?={re.escape(w)})", t)])


@pytest.mark.parametrize("block_ids", [1 << 20, 2000])
def test_token_store(docs, spark, block_ids):
    from tokenizers import Tokenizer

    path = shared_folder(spark, "test-ids")
    name = vocabulary("word_bpe_49k.json")
    write_ids(docs, path, name, block_ids=block_ids)
    blocks = spark.read.parquet(path)
    assert (blocks.agg(F.max("block")).first()[0] > 0) == (block_ids == 2000)
    plain = Tokenizer.from_file(name)
    got = sorted(read_ids(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in pairs_of(docs)), key=lambda i: (i is None, i or 0))
    texts, at = collections.defaultdict(list), 0
    for i, t in pairs_of(docs):
        texts[i].append(plain.encode(t or "", add_special_tokens=False).ids + [1])
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        texts[r.doc_id].remove(r.ids)
        at += r.n_tokens


def test_language_id(spark, small):
    docs = documents(spark, small)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = fit_on(docs.where(~held))
    rows = identify(docs, model).join(docs.where(held).select("doc_id", "lang"), "doc_id").collect()
    right = sum(r.lang == r.lang_pred for r in rows)
    assert right >= 0.97 * len(rows) and sum(r.accepted for r in rows) >= 0.97 * len(rows)
    odd = {r.doc_id: r for r in identify(edge_rows(spark), model).collect()}
    assert [odd[i].lang_pred for i in (1, 2, 3, 18)] == ["und"] * 4 and not odd[1].accepted and odd[4].lang_pred in model.languages
    assert all(0 <= r.score <= 1 for r in odd.values())
    assert {r.lang_pred for r in identify(docs, fit_on(empty(spark))).collect()} == {"und"}


def test_predictions_are_those_of_plain_counting(spark, small):
    """Subwords of a text counted one by one, their mean score through the softmax."""
    docs = documents(spark, small).limit(80).union(spark.createDataFrame([(90_001, "Ab  c", "en", "s", 0), (90_002, "é", None, "s", 0), (90_003, "x", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    model = fit_on(docs)
    got = {r.doc_id: r for r in identify(docs, model).collect()}

    def bucket(code, n):
        value = 0
        for c in code:
            value = (value * 257 + c) % (1 << 64)
        return int(mix(np.array([(value + (n << 40)) % (1 << 64)], np.uint64))[0]) % BUCKETS

    for i, t in pairs_of(docs):
        code = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in t.encode()]
        grams = [bucket(code[k : k + n], n) for n in (2, 3, 4) for k in range(len(code) - n + 1) if code[k] or code[k + 1]]
        z = (model.scores[grams].sum(axis=0, dtype=np.float64) / (len(grams) + PRIOR) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[i].lang_pred == model.languages[p.argmax()] and abs(got[i].score - p.max()) < 1e-6
        assert got[i].accepted == (got[i].score >= model.threshold)


def test_sharding(docs):
    rows = pairs_of(docs)
    got = balanced_shards(docs, 5).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"rows"}
    count = collections.Counter(r.shard for r in got)
    assert max(count.values()) - min(count.values()) <= 1
    for s in count:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(count[s]))
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)


def test_sharding_keeps_groups_and_splits_the_largest(spark):
    rows = [(i, f"group {i % 40}" if i < 200 else "hot" if i < 300 else f"alone {i}") for i in range(400)]
    got = balanced_shards(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    where = collections.defaultdict(set)
    for r in got:
        where[rows[r.doc_id][1]].add(r.shard)
    assert collections.Counter(r.shard for r in got) == {s: 50 for s in range(8)}
    assert len(where["hot"]) <= 4 and sum(len(where[f"group {k}"]) == 1 for k in range(40)) >= 36


def shards_of_texts(spark, texts, n_shards):
    got = balanced_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), n_shards).collect()
    where = collections.defaultdict(collections.Counter)
    for r in got:
        where[texts[r.doc_id]][r.shard] += 1
    assert set(collections.Counter(r.shard for r in got).values()) == {len(texts) // n_shards}
    return where


def test_sharding_gathers_a_third_of_the_rows_in_as_few_shards_as_hold_it(spark):
    where = shards_of_texts(spark, ["hot" if i < 800 else f"alone {i}" for i in range(2400)], 40)
    assert sorted(where["hot"].values()) == [20] + [60] * 13


def test_sharding_exchanges_members_of_full_shards(spark):
    where = shards_of_texts(spark, [f"group {i % 60}" for i in range(240)], 4)  # every document is linked
    assert sum(len(c) == 1 for c in where.values()) >= 30


def test_packing(docs):
    from tokenizers import Tokenizer

    name = vocabulary("byte_bpe_50k.json")
    plain = Tokenizer.from_file(name)
    rows = pack(docs, name, window=512).collect()
    texts = collections.Counter()
    for i, t in pairs_of(docs):
        texts[i, tuple(plain.encode(t or "", add_special_tokens=False).ids + [1])] += 1
    want = collections.Counter()
    for (i, ids), n in texts.items():
        want[i] += n * len(ids)
    got, lanes = collections.Counter(), collections.defaultdict(list)
    by_id = {i: np.array(ids, "<u4") for i, ids in texts}
    for r in rows:
        got[r.doc_id] += r.length
        lanes[r.sequence_id].append((r.offset, r.length))
        ids = by_id[r.doc_id]
        assert r.doc_tokens == len(ids) and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert got == want
    for lane in lanes.values():
        at = 0
        for offset, length in sorted(lane):
            assert offset == at
            at += length
        assert at <= 512
    assert sorted(lanes) == list(range(len(lanes)))


def test_item_values_are_those_of_the_item_alone():
    texts = [" ".join(f"{k}w{i}" for i in range(n)) for k, n in enumerate((30, 5, 200, 3, 0, 9, 31, 6, 200))]
    together, alone = ItemBlock(list(range(9)), texts, 5, 8), [ItemBlock([0], [t], 5, 8) for t in texts]
    for u, keys in together.parts:
        for k, (values, items) in enumerate(keys):
            assert [dict(alone[i].parts)[u][k][0][0] for i in items] == values.tolist()


def test_contained_items(docs, spark, small):
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    more = spark.createDataFrame([(900, None), (901, ""), (902, "too few words"), (905, "Here"), (906, "words two"), (907, "two Words"), (903, "same text of six words here"), (None, "no id here at all"), (904, " ".join(f"passage{i}" for i in range(10, 60)))], "item_id long, text string")
    items = items.select("item_id", "text").union(more)

    def shingles(t):
        w = WORDS(LOWER(t))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    wanted = [(r.item_id, shingles(r.text)) for r in items.collect()]
    want = collections.Counter()
    for i, t in pairs_of(docs):
        w = WORDS(LOWER(t))
        own = {n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for n in range(1, 6)}
        for k, s in wanted:
            n = len(next(iter(s), ()))
            if s and 100 * len(s & own[n]) >= 75 * len(s):
                want[i, k, len(s & own[n]), len(s), n < 5] += 1
    got = collections.Counter((r.doc_id, r.item_id, r.n_shared, r.n_item, r.short_item) for r in contained_items(docs, items, block_items=20).collect())
    assert got == want and want


@pytest.mark.parametrize("operator", [near_duplicates, quality_rules, license_scan, substring_dedup, suffix_dedup, balanced_shards, lambda d: pack(d, vocabulary("byte_bpe_50k.json")), lambda d: contained_items(d, d.select(F.col("doc_id").alias("item_id"), "text"))])
def test_empty_tables(spark, operator):
    assert operator(empty(spark)).count() == 0


def test_empty_token_store(spark):
    path = shared_folder(spark, "test-ids")
    write_ids(empty(spark), path, vocabulary("word_bpe_49k.json"))
    assert read_ids(spark, path).count() == 0


def test_all_ten_are_registered():
    assert [sum(k.startswith(f"op{n}_") for k in QUERIES) for n in range(1, 11)] == [1] * 10
