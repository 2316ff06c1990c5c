"""A corpus pipeline of five stages; each takes the documents that the one before kept.

``STAGES`` holds (name, function); a function takes (spark, docs, sf_dir).  All but the
last return the columns of ``documents``, whatever their names.  ``run`` writes each
stage's result as Parquet into the shared folder, reads it again for the next, and deletes
what a stage no longer needs; its own result stays (``shared_windows.release`` deletes it).

Every stage gives no rows for an empty table, takes texts whole however long they are, and
treats repeated rows and rows with null ids as documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hushframe.llm import bpe_pairs, decontaminate, jaccard_trie, secret_scan, toxicity_cnn
from hushframe.llm.queries import table, tokenizer_path
from hushframe.llm.shared_windows import release, remove, work_dir


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects by their language's threshold go.  Null and
    empty texts have the score of no words and stay, as do all where nothing is labelled;
    a null language has the threshold of all languages."""
    model = toxicity_cnn.train_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity_cnn.reject_toxic(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the one with the smallest id stays; ids that are
    null come last, and of equal ids one row stays.  Null, empty and blank texts are linked
    with nothing and stay."""
    return jaccard_trie.deduplicate(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go, each of them where texts are repeated.
    Null and empty texts are clean and stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), "documents")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced; every document stays, null texts stay null."""
    return secret_scan.redact_secrets(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of the documents, as counts and digests, a row each; a null
    text is encoded as the empty one."""
    return bpe_pairs.bpe_encode(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: A trained classifier decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's result."""
    root = work_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{i}_{name}")
        docs = spark.read.parquet(f"{root}/{i}_{name}")
        release(spark, root)
        if i:
            remove(spark, f"{root}/{i - 1}_{STAGES[i - 1][0]}")
    return docs
