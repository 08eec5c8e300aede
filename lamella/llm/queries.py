"""Registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_digests
from .centroids import centroid_clusters
from .decontaminate import contained_items
from .hard_negatives import hard_negatives
from .language_id import fit_on, identify
from .license_scan import license_scan
from .near_dedup import near_duplicates
from .oracle import ORACLE_SQL  # noqa: F401
from .packing import pack
from .quality_rules import quality_rules
from .shared import shared_folder
from .sharding import balanced_shards
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .token_store import read_ids, write_ids


#: Least bytes of a repeated passage that op6 reports beside what it removes.
PASSAGE_BYTES = 200


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies; ``LAMELLA_TOKENIZERS`` names another folder."""
    if folder := os.environ.get("LAMELLA_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("n_links")


def op2_suffix_array_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("n_repeats")


def op3_sentence_rule_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op4_recompression_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), with_text=False)


def op5_huffman_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "token-ids")
    write_ids(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    return read_ids(spark, path, with_ids=False)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), passage=PASSAGE_BYTES, with_text=False)


def op7_subword_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = fit_on(docs.where(~held_out))
    return identify(docs, model).select("doc_id", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


def op8_balanced_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(table(spark, sf_dir, "documents"))


def op9_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_minhash_containment_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op12_laesa_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


def op13_segment_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, rows.where("vec_id % 100 = 0"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_suffix_array_quality_rules,
        op3_sentence_rule_license_scan,
        op4_recompression_substring_dedup,
        op5_huffman_token_store,
        op6_suffix_array_dedup,
        op7_subword_language_id,
        op8_balanced_label_propagation,
        op9_nnls_packing,
        op10_minhash_containment_decontamination,
        op11_tree_bpe,
        op12_laesa_centroids,
        op13_segment_hard_negatives,
    )
}

