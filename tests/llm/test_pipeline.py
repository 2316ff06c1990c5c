"""Every stage's decisions, on what its predecessor kept."""

from hushframe.llm import decontaminate, secret_scan

import corpus_pipeline

from ..oracle import SF
from . import brute


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).persist()
        kept[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "near_duplicates":
            rows = [(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()]
            classes = brute.components(rows)
            assert {r["doc_id"] for r in docs.collect()} == {c for _, n, c in classes if n} | {d for d, n, _ in classes if not n}
        if name == "benchmark_passages":
            found = decontaminate.contamination_digest(before, spark.read.parquet(f"{SF}/benchmark.parquet"))
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in found.where("not contaminated").collect()}
        if name == "secrets":
            assert docs.count() == before.count()
            assert secret_scan.secret_digest(docs).where("spans <> ''").count() == 0
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    clean = whole.join(labels.where("toxic = 0"), "doc_id", "left_semi")
    assert kept["toxicity"].join(clean, "doc_id", "left_semi").count() >= 0.97 * clean.count()
    assert docs.count() == kept["secrets"].count()
