"""The subpackage's registered queries: each applies its operator, with production
parameters, to the whole of its table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import bpe_pairs, decontaminate, embedding_whitening, jaccard_trie, language_ppm, periodic_runs, quality_repeats, secret_scan, simhash_anchors, suffix_array_dedup, suffix_tree_dedup, toxicity_cnn, warc_index
from .oracles import ORACLE_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer files lie; TOKENIZER_DIR overrides it."""
    root = os.environ.get("TOKENIZER_DIR")
    if root:
        return os.path.join(root, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_repeats.repetition_quality(table(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op3_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_cnn.train_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity_cnn.score_toxicity(docs, model)


def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_index.archive_round_trip(table(spark, sf_dir, "pages"))


def op5_jaccard_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_trie.jaccard_classes(table(spark, sf_dir, "documents"))


def op6_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_dedup.remove_passages(table(spark, sf_dir, "documents"))


def op7_bpe_pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_pairs.bpe_encode(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_ppm.identify_language(docs, language_ppm.train_ppm(docs))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_secret_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digest(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_whitening.whitened_rows(table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.runs_digest(table(spark, sf_dir, "documents"))


def op13_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_anchors.simhash_digest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_suffix_repetition, op2_suffix_array_dedup, op4_warc_index, op5_jaccard_trie, op6_suffix_tree_dedup, op3_toxicity_cnn, op7_bpe_pair_index, op8_language_ppm, op9_decontaminate, op10_secret_trigrams, op11_embedding_whitening, op12_periodic_runs, op13_simhash_anchors)}

__all__ = ["ORACLE_SQL", "QUERIES", "table", "tokenizer_path"]
