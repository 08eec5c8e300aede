"""Corpus pipeline: five stages of the training-data operators, one after another.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and
returns a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of ``documents``.  No stage can be told in SQL, so
ORACLE_SQL is None and tests hold ``run`` against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamella.llm.decontaminate import contained_items
from lamella.llm.language_id import fit_on, identify
from lamella.llm.near_dedup import near_duplicates
from lamella.llm.packing import pack
from lamella.llm.queries import PASSAGE_BYTES, vocabulary
from lamella.llm.shared import written
from lamella.llm.suffix_dedup import suffix_dedup

#: Words of the shortest passage that counts as a repeat.
PASSAGE_WORDS = 50
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is told with an accepted score; lang becomes what was told.

    Each row is judged by its whole text: null ids and repeated rows stay rows of their own; a
    null or letterless text goes.  An empty table gives an empty result; other columns than those of
    ``documents`` go."""
    told = identify(docs, fit_on(docs), carry=("text", "source", "n_chars")).where("accepted")
    return told.withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


#: Rows of a list that goes to every task; a longer one is joined by a shuffle.
FEW_KEYS = 100_000


def keyed(docs: DataFrame, *names: str) -> DataFrame:
    """docs with ``__key``, a number that rows have in common if, and only if, they agree in the columns ``names`` (the last a text).

    The key is the first half of 128 bits of a digest; rows whose half is shared by another
    digest take the second half instead, so that no two documents are ever taken for one."""
    said = [x for c in names for x in (F.isnull(c).cast("string"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"))]
    half = lambda at: F.conv(F.substring("__sha", at, 16), 16, -10).cast("long")
    rows = docs.withColumn("__sha", F.sha2(F.concat(*said), 256)).withColumns({"__key": half(1), "__other": half(17)}).drop("__sha")
    shared = rows.groupBy("__key").agg(F.min("__other").alias("a"), F.max("__other").alias("z")).where("a <> z").select("__key", F.lit(True).alias("__shared"))
    shared = written(shared, "shared-keys")
    if n := shared.count():
        rows = rows.join(F.broadcast(shared) if n <= FEW_KEYS else shared, "__key", "left").withColumn("__key", F.when(F.col("__shared"), F.col("__other")).otherwise(F.col("__key"))).drop("__shared")
    return rows.drop("__other")


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group, the one with the least id.

    Of rows that repeat an id and a text one stays, that with the least other columns.
    Each distinct (id, text) is a document of its own, named by a digest of both; null ids come first.
    Null, empty and wordless texts stay; a very long text is compared whole; an empty table gives an
    empty result; other columns than those of ``documents`` go."""
    named = keyed(docs.select(*COLUMNS), "doc_id", "text")
    groups = near_duplicates(named, id_col="__key").select("__key", "component_id").distinct()
    ids = named.select("__key", "doc_id").distinct()
    stays = groups.join(ids, "__key").groupBy("component_id").agg(F.min(F.struct(F.isnotnull("doc_id").alias("named"), "doc_id", "__key")).alias("s")).select("s.__key")
    same = Window.partitionBy("__key").orderBy("lang", "source", "n_chars")
    return named.join(stays, "__key", "left_semi").withColumn("__nth", F.row_number().over(same)).where("__nth = 1").select(*COLUMNS)


def repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 50 words or more that an earlier document, or an earlier place, has; the first copy stays.

    A passage is a run of whole words covered by repeated strings of PASSAGE_BYTES.
    Every row stays a row with what is left of its text, whatever its id; a null text becomes an empty one.
    A very long text is worked on whole; an empty table gives an empty result; other columns than those of
    ``documents`` go."""
    kept = suffix_dedup(docs, window=PASSAGE_BYTES, first_stays=True, least_words=PASSAGE_WORDS, carry=("lang", "source"))
    return kept.withColumnRenamed("kept_text", "text").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain a benchmark item of five words or more.

    Rows go by their text, named by its digest, so null and repeated ids do not matter; null and empty texts
    stay.  A very long text is searched whole; an empty table gives an empty result; other columns than those
    of ``documents`` go."""
    named = keyed(docs.select(*COLUMNS), "text")
    leaks = contained_items(named, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="__key").where("not short_item").select("__key").distinct()
    return named.join(leaks, "__key", "left_anti").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens; every row is a document, whatever its id.

    Null and empty texts have the end id alone; repeated rows are packed each for itself; a very long text
    fills sequences of its own; an empty table gives an empty result."""
    return pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language", language),
    ("near_duplicate", near_duplicate),
    ("repeated_bytes", repeated_bytes),
    ("decontaminated", decontaminated),
    ("packed", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
