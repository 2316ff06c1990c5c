import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("key", T.StringType()), T.StructField("row", T.LongType())])


def frame(spark, rows):
    """Documents with columns that clash with names used inside; rows: (doc_id, text)."""
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), "k", 7) for d, t in rows], SCHEMA)


def corpus(seed=5, docs=60):
    """Prose with shared passages, copies, near copies, nulls, ties and one long text."""
    r = random.Random(seed)
    word = lambda: r.choice(["the", "of", "and", "to"]) if r.random() < 0.4 else "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, rows = text(60), []
    for i in range(docs):
        body = text(r.randrange(3, 150))
        if i % 4 == 0:
            body = body[: len(body) // 2] + " " + shared + "\n" + body[len(body) // 2 :]
        rows.append((i, body))
    for i in range(10):
        w = rows[i][1].split(" ")
        w[len(w) // 2] = "edited"
        rows += [(100 + i, rows[i][1]), (200 + i, " ".join(w))]
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "one two"), (304, "one two"), (None, shared), (None, None), (305, "nd " * 400), (306, "x" * 300), (307, "x" * 300), (308, text(4000)), (0, rows[0][1]), (309, "💥é " * 40)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()
