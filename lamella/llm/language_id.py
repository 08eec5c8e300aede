"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's subwords are the byte 2-, 3- and 4-grams of its letters (upper case A-Z
read as lower case, other ASCII read as a gap), each hashed to a row of an embedding
table.  Their average goes through a linear softmax.  Table and weights are trained by
stochastic gradient descent in numpy on a bounded sample of labelled documents; the
feature counts of the sample are made by Spark over whole texts.

Averaging and the linear map commute, so for prediction each subword has one score
per language, and a text costs one table look-up per subword, however long it is.
A temperature, fitted on a tenth of the sample that training never sees, calibrates
the scores.  The least score that is accepted is the one that ``lost`` of the correct
documents there would fall under, at most ``most_threshold``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbits as tb

UNKNOWN = "und"
BUCKETS = 1 << 15
GRAMS = (2, 3, 4)
#: Subwords without an opinion that every text has besides its own: short texts get low scores.
PRIOR = 10

_CLASS = np.zeros(256, np.uint64)  # gap
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def features(buf: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each gram size: (size, bucket of each place, whether the gram there counts)."""
    code = _CLASS[buf]
    for n in GRAMS:
        m = len(buf) - n + 1
        if m <= 0:
            continue
        value = np.zeros(m, np.uint64)
        for k in range(n):
            value = value * np.uint64(257) + code[k : k + m]
        good = code[:m] > 0
        middle = code[1 : m + 1] > 0  # two gaps in a row say nothing
        yield n, (tb.mix(value + np.uint64(n << 40)) & np.uint64(BUCKETS - 1)).astype(np.int32), good | middle


def _spans(offs: np.ndarray, n: int, m: int) -> np.ndarray:
    return np.minimum(np.maximum(offs[1:] - n + 1, offs[:-1]), m)


@dataclass
class LanguageModel:
    languages: list[str]
    scores: np.ndarray  # BUCKETS x languages, of one subword
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits of each text, and the number of its subwords."""
        n_texts, k = len(offs) - 1, len(self.languages)
        total, count = np.zeros((n_texts, k)), np.zeros(n_texts, np.int64)
        some = np.flatnonzero(np.diff(offs))
        for n, bucket, good in features(buf):
            m = len(bucket)
            inside = np.zeros(m, bool)
            stop = _spans(offs, n, m)
            inside[tb.ranges(np.minimum(offs[:-1], m), np.maximum(stop - np.minimum(offs[:-1], m), 0))] = True
            inside &= good
            count += tb.segment_sum(inside, np.minimum(offs, m))
            at = np.minimum(offs[:-1][some], m - 1)
            for c in range(k):
                value = self.scores[:, c][bucket]
                value[~inside] = 0
                sums = np.add.reduceat(value, at, dtype=np.float64)
                sums[offs[:-1][some] >= m] = 0
                total[some, c] += sums
        return total / (count + PRIOR)[:, None] + self.bias, count

    def predict(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the likeliest language and its calibrated probability."""
        logits, _ = self.logits(buf, offs)
        p = _softmax(logits / self.temperature)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def sample_counts(labelled: DataFrame) -> DataFrame:
    """Subword counts over the whole text of each row of ``labelled(id, text, lang)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches):
            buf, offs = tb.text_buffer(batch.column("text"))
            out = []
            for a, z in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                counts = np.zeros(BUCKETS, np.int64)
                for _, bucket, good in features(buf[a:z]):
                    counts += np.bincount(bucket[good], minlength=BUCKETS)
                some = np.flatnonzero(counts)
                out.append((some.astype("<i4").tobytes(), counts[some].astype("<i4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("lang"), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], names=["id", "lang", "buckets", "counts"])

    return labelled.select("id", "lang", "text").mapInArrow(run, "id long, lang string, buckets binary, counts binary")


def train(rows: list, dim: int = 16, epochs: int = 5, rate: float = 0.2, lost: float = 0.001, most_threshold: float = 0.5, seed: int = 11) -> LanguageModel:
    """Fits the model to rows of ``sample_counts``."""
    rows = sorted(rows, key=lambda r: (r["id"], r["lang"]))
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    label = np.array([languages.index(r["lang"]) for r in rows])
    at = [np.frombuffer(r["buckets"], "<i4") for r in rows]
    share = [(c := np.frombuffer(r["counts"], "<i4").astype(np.float32)) / (c.sum() + PRIOR) for r in rows]
    rng = np.random.RandomState(seed)
    order = rng.permutation(len(rows))
    held, fit = order[: len(rows) // 10], order[len(rows) // 10 :]
    table = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    weights, bias = np.zeros((dim, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    seen_table, seen_weights, seen_bias = np.full_like(table, 1e-12), np.full_like(weights, 1e-12), np.full_like(bias, 1e-12)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(fit):
            if not len(at[i]):
                continue
            mean = share[i] @ table[at[i]]
            z = mean @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label[i]] -= 1
            # each gradient is divided by the root of the squares of its own past (AdaGrad)
            by_weight, by_row = np.outer(mean, p), np.outer(share[i], weights @ p)
            seen_weights += by_weight**2
            seen_bias += p**2
            seen = seen_table[at[i]] + by_row**2
            seen_table[at[i]] = seen
            table[at[i]] -= step * by_row / np.sqrt(seen)
            weights -= step * by_weight / np.sqrt(seen_weights)
            bias -= step * p / np.sqrt(seen_bias)
    model = LanguageModel(languages, np.ascontiguousarray((table @ weights).astype(np.float32)), bias.astype(np.float64))
    proof = [i for i in (held if len(held) >= 20 else order) if len(at[i])]
    if proof:
        z = np.stack([share[i] @ model.scores[at[i]] + bias for i in proof]).astype(np.float64)
        y = label[proof]

        def loss(t: float) -> float:
            return float(-np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean())

        model.temperature = min(np.geomspace(1, 20, 40), key=loss)
        p = _softmax(z / model.temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == y]
        if len(right):
            model.threshold = min(float(np.quantile(right, lost)) * 0.999, most_threshold)
    return model


def fit_on(docs: DataFrame, sample_rows: int = 2000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Trains on at most ``sample_rows`` rows of docs with a label, chosen by a hash of their id.

    The bound is on what the classifier is fitted to; every text is predicted.  Rows with a null
    id, text or label are not learned from; rows that repeat count once.  Without any labelled
    row the model knows no language.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = plain.where(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull()).withColumn("of", F.xxhash64("text"))
    row = ["id", "of", "lang"]
    chosen = known.select(*row).distinct().orderBy(F.xxhash64("id"), *row).limit(sample_rows)
    sample = known.join(F.broadcast(chosen), row).groupBy(*row).agg(F.any_value("text").alias("text"))
    return train(sample_counts(sample).collect())


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Returns ``id_col, lang_pred, score, accepted`` for each row of docs; only the text decides.

    lang_pred is a learned language, or ``und`` if the text is null, has no letter, or nothing was
    learned; then score is 0 and the row is not accepted.  accepted: score is at least the
    model's threshold.  Repeated rows share a result; null ids are kept.  An empty table gives an
    empty result.  A very long text is read whole.  The columns named in ``carry`` come along,
    others are ignored.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)  # BUCKETS x languages floats, whatever the corpus
    names = np.array([*model.languages, UNKNOWN])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in tb.slices(batches):
            letters = np.asarray(batch.column("letters"))
            if m.languages:
                best, score = m.predict(*tb.text_buffer(batch.column("text")))
            else:
                best, score = np.zeros(len(letters), np.int64), np.zeros(len(letters))
            ok = letters & bool(m.languages)
            score = np.where(ok, score, 0.0)
            pred = names[np.where(ok, best, len(names) - 1)]
            told = [batch.column("id"), pa.array(pred.tolist(), pa.string()), pa.array(score), pa.array(ok & (score >= m.threshold))]
            yield pa.RecordBatch.from_arrays(told + [batch.column(c) for c in beside], names=["id", "lang_pred", "score", "accepted", *beside])

    text = F.col(text_col).cast("string")
    beside = [f"c{k}" for k in range(len(carry))]
    along = [F.col(c).alias(b) for c, b in zip(carry, beside, strict=True)]
    plain = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"), *along)
    schema = "id long, lang_pred string, score double, accepted boolean" + "".join(f", {b} {docs.schema[c].dataType.simpleString()}" for c, b in zip(carry, beside, strict=True))
    return plain.mapInArrow(run, schema).select(F.col("id").alias(id_col), "lang_pred", "score", "accepted", *[F.col(b).alias(c) for c, b in zip(carry, beside, strict=True)])
