"""Training where the labelled rows are more than one task fits: every row counts."""

import numpy as np
from pyspark.sql import functions as F

from hushframe.llm import toxicity_cnn

LIMITS = toxicity_cnn.TrainLimits(max_rows=200, toxic_rows=40, shard_rows=1500, buckets=1 << 12)


def _tables(spark, rare):
    """Toxic rows hold a bad word; those of ``rare`` another one, and lie outside the start."""
    rng = np.random.default_rng(3)
    words = np.array([f"word{i}" for i in range(60)])
    rows = [(i, " ".join(rng.choice(words, 12)) + (" wretched" if i % 5 == 0 else ""), "en", int(i % 5 == 0)) for i in range(3000)]
    rows += [(10_000 + i, " ".join(rng.choice(words, 12)) + " dismal", "de", 1) for i in range(rare)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    return df.select("doc_id", "text", "lang"), df.select("doc_id", "toxic")


def test_rows_outside_the_start_are_learned(spark, monkeypatch):
    docs, labels = _tables(spark, 1200)
    started = {}
    start = toxicity_cnn._start

    def without_rare(texts, known, limits, part=False):
        model, whole = start(texts, known.where("doc_id < 10000"), limits, part)
        started["model"] = model
        return model, whole

    monkeypatch.setattr(toxicity_cnn, "_start", without_rare)
    model = toxicity_cnn.train_toxicity(docs, labels, LIMITS)
    rare = docs.where("lang = 'de'")
    mean = lambda m: np.mean([r["score"] for r in toxicity_cnn.score_toxicity(rare, m, LIMITS).collect()])
    assert mean(model) > mean(started["model"]) + 0.2


def test_thresholds_count_every_row_kept_out(spark):
    docs, labels = _tables(spark, 100)
    model = toxicity_cnn.train_toxicity(docs, labels, LIMITS)
    joined = docs.join(labels, "doc_id")
    got = toxicity_cnn.calibrated(model, joined, LIMITS)
    scores = {r["doc_id"]: r["score"] for r in toxicity_cnn.score_toxicity(docs, model, LIMITS).collect()}
    rows = joined.collect()
    s, y = np.floor([scores[r["doc_id"]] * 4096 for r in rows]) / 4096, np.array([r["toxic"] for r in rows])
    assert got.threshold == toxicity_cnn.threshold(s, y, LIMITS, LIMITS.floor)
    for lang in ("en", "de"):
        of = np.array([r["lang"] == lang for r in rows])
        assert got.thresholds[lang] == toxicity_cnn.threshold(s[of], y[of], LIMITS, got.threshold)


def test_few_texts_without_labels_travel(spark):
    """Of 4,000 texts 500 are labelled: those are shuffled once, others hardly."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abcdefghij"), (150, 12)).view("U12").ravel()) for _ in range(4000)]
    docs = spark.createDataFrame([(i, t + (" wretched" if i % 3 == 0 else ""), "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(4).localCheckpoint()
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 4000, 8)], "doc_id long, toxic int")
    written = lambda: sum(x.totalShuffleWrite() for x in map(spark.sparkContext._jsc.sc().statusStore().executorList(True).apply, range(1)))
    before = written()
    toxicity_cnn.train_toxicity(docs, labels, LIMITS)
    whole = sum(map(len, texts))
    assert 0 < written() - before < whole / 3


def test_every_known_id_is_likely_and_few_others(spark):
    docs = spark.range(-20_000, 20_000).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("x"))
    known = docs.where("doc_id % 5 = 0").select("doc_id", F.lit(1).alias("toxic"))
    got = toxicity_cnn._likely(docs, known)
    assert got.columns == docs.columns
    assert got.join(known, "doc_id").count() == known.count() == 8000
    assert got.count() < 8000 + 0.2 * 32_000
    strings = [x.select(F.col("doc_id").cast("string").alias("doc_id"), *x.columns[1:]) for x in (docs, known)]
    assert toxicity_cnn._likely(*strings).join(strings[1], "doc_id").count() == 8000
    # ids of another type: the join casts them, so all pass
    assert toxicity_cnn._likely(docs, strings[1]).count() == docs.count()


def test_labels_that_come_beside_give_the_same_thresholds(spark):
    docs, labels = _tables(spark, 100)
    model = toxicity_cnn.train_toxicity(docs, labels, LIMITS)
    twice = docs.union(docs.where("doc_id < 50"))
    own = toxicity_cnn.calibrated(model, twice.join(labels, "doc_id"), LIMITS)
    own = own.threshold, own.thresholds
    beside = toxicity_cnn.calibrated(model, twice, LIMITS, labels)
    assert (beside.threshold, beside.thresholds) == own


def test_shards_do_not_follow_the_session(spark):
    """More shuffle partitions than shards, and a join that is shuffled: the same model."""
    docs, labels = _tables(spark, 100)
    start, _ = toxicity_cnn._start(docs.withColumn("size", F.octet_length("text")), labels, LIMITS, True)
    found = []
    for partitions in ("2", "7"):
        kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            found.append(toxicity_cnn.refined(start, docs, LIMITS, labels))
        finally:
            for k, v in kept.items():
                spark.conf.set(k, v)
    for a, b in zip(*map(toxicity_cnn._values, found)):
        assert np.allclose(a, b, atol=1e-5)


def test_texts_are_shuffled_once_whatever_the_number_of_labels(spark):
    """Labels too many for a broadcast: the texts still move once, into their shards."""
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(list("abcdefghij"), (150, 12)).view("U12").ravel()) for _ in range(2000)]
    docs = spark.createDataFrame([(i, t + (" wretched" if i % 3 == 0 else ""), "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(4).localCheckpoint()
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(2000)], "doc_id long, toxic int").localCheckpoint()
    limits = toxicity_cnn.TrainLimits(max_rows=200, toxic_rows=40, shard_rows=1500, buckets=1 << 8)
    start, _ = toxicity_cnn._start(docs.withColumn("size", F.octet_length("text")), labels, limits, True)
    written = lambda: sum(x.totalShuffleWrite() for x in map(spark.sparkContext._jsc.sc().statusStore().executorList(True).apply, range(1)))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        toxicity_cnn.refined(start, docs, limits, labels)
        assert 0 < written() - before < 1.4 * sum(map(len, texts))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_shards_hold_the_rows_of_a_join(spark):
    """Repeated and null ids, texts without labels, labels without texts, ids of another type."""
    docs = spark.createDataFrame([(i % 40 if i % 7 else None, f"text {i}") for i in range(300)], "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(0, 60, 3)], "doc_id long, toxic int")
    strings = known.select(F.col("doc_id").cast("string").alias("doc_id"), "toxic")
    want = sorted(map(tuple, docs.join(known, "doc_id").select("text", "toxic").collect()))
    assert want
    for labels in (known, strings):
        got = toxicity_cnn._sharded(docs, labels, 3)
        assert got.rdd.getNumPartitions() == 3
        assert sorted(map(tuple, got.collect())) == want
