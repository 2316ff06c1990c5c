"""Whitening, periodic runs and SimHash classes against plain versions."""

import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from hushframe.llm import embedding_whitening, periodic_runs, simhash_anchors
from hushframe.llm.queries import QUERIES

from ..oracle import SF
from . import brute
from .conftest import frame


# Whitening.

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("VEC_ID", T.StringType()), T.StructField("x", T.LongType()), T.StructField("size", T.LongType())])


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "k", 1, 2) for i, v in rows], VECTORS)


def integer_vectors(rows, size):
    good = [(i, v) for i, v in rows if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]
    return [(i, tuple(math.floor(64 * Fraction(c)) + 1_000_000 for c in v)) for i, v in good]


def check_whitening(found, rows, size, close=1e-7):
    whole = integer_vectors(rows, size)
    fit = sorted({x for _, x in whole})
    n, sums = len(fit), [sum(x[d] for x in fit) for d in range(size)]
    deviation = Counter((i, n, sum((n * x[d] - sums[d]) ** 2 for d in range(size))) for i, x in whole)
    assert Counter((r["vec_id"], r["n"], r["deviation"]) for r in found if r["component"] == 1) == deviation
    scatter = [[n * sum(x[i] * x[j] for x in fit) - sums[i] * sums[j] for j in range(size)] for i in range(size)]
    values, vectors = np.linalg.eigh(np.array([[Fraction(v, n * n) for v in row] for row in scatter], float))
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(Fraction(sum(scatter[i][i] for i in range(size)), n * n))
    expected = {}
    for i, x in whole:
        centred = np.array([float(Fraction(n * a - b, n)) for a, b in zip(x, sums)])
        expected.setdefault(i, []).append(np.abs(centred @ vectors) / np.sqrt(np.maximum(values, 1e-300)))
    for r in found:
        k = r["component"] - 1
        assert min(abs(abs(r["whitened"]) - e[k]) for e in expected[r["vec_id"]]) < close * max(1, abs(r["whitened"]))
        assert abs(r["explained"] - values[k] / trace) < 1e-9 and r["identity_error"] < 1e-6
    for k in {r["component"] for r in found}:  # one sign for all rows
        own = [(r["vec_id"], r["whitened"]) for r in found if r["component"] == k]
        assert len(own) == len(whole)


def test_whitening(spark):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1 + d) for d in range(5)]) for i in range(200)]
    rows += [(i + 1000, rows[i % 3][1]) for i in range(300)]  # many copies count once
    rows += [(None, rows[5][1]), (5007, None), (5008, [1.0, None, 0.0, 0.0, 0.0]), (5009, [math.nan] * 5), (5010, [math.inf, 0.0, 0.0, 0.0, 0.0]), (5011, [1.0, 2.0]), (5012, []), (5013, [1e300, 0.0, 0.0, 0.0, 0.0])]
    df = vectors(spark, rows).repartition(7)
    usable = [row for row in rows if row[0] != 5013]  # beyond a long
    found = embedding_whitening.whitened_rows(df).collect()
    assert {x["component"] for x in found} == {1, 2, 3, 4, 5}
    check_whitening(found, usable, 5)
    assert embedding_whitening.whitened_rows(df, 2).where("component > 2").count() == 0


def test_whitening_of_large_numbers(spark):
    """Sums beyond a long and a large common shift lose nothing."""
    r = random.Random(5)
    rows = [(i, [1e13 + r.randrange(1000), -3e12 * r.random(), r.random()]) for i in range(60)]
    found = embedding_whitening.whitened_rows(vectors(spark, rows)).collect()
    whole = integer_vectors(rows, 3)
    n, sums = len({x for _, x in whole}), [sum(x[d] for _, x in whole) for d in range(3)]
    expected = {i: sum((n * x[d] - sums[d]) ** 2 for d in range(3)) for i, x in whole}
    assert all(x["n"] == n and x["deviation"] == (expected[x["vec_id"]] if expected[x["vec_id"]] < 1 << 63 else None) for x in found)
    # the other eigenvalues are zero beside the first, to double precision
    assert {x["component"] for x in found} == {1} and max(x["identity_error"] for x in found) < 1e-4
    table = np.array([[(1 << 62) + 5, -(1 << 61)], [3, 1 << 40]])
    exact = [[sum(int(t[i]) * int(t[j]) for t in table) for j in range(2)] for i in range(2)]
    assert embedding_whitening.products(table).tolist() == exact


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [2.0, 3.0]), (2, [2.0, 3.0])]])
def test_whitening_without_spread(spark, rows):
    assert embedding_whitening.whitened_rows(vectors(spark, rows)).collect() == []


def test_registered_whitening(spark):
    found = QUERIES["op11_embedding_whitening"](spark, SF).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_whitening(found, rows, 64)
    assert Counter(r["component"] for r in found) == Counter({k: len(rows) for k in range(1, 17)})


# Periodic runs.


def plain_runs(words, least=6, exponent=4):
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def some_words(r):
    kind = r.randrange(6)
    if kind == 0:
        return [r.choice("ab") for _ in range(r.randrange(120))]
    if kind == 1:
        return [r.choice("abc") for _ in range(r.randrange(60))] * r.randrange(1, 6)
    if kind == 2:
        return ["a"] * r.randrange(100)
    if kind == 3:
        return (["a"] * r.randrange(1, 9) + ["b"] * r.randrange(3)) * r.randrange(1, 40)
    if kind == 4:
        x = []
        for _ in range(r.randrange(1, 12)):
            x += [r.choice("abcd") for _ in range(r.randrange(1, 4))] * r.randrange(1, 8)
        return x + ["z"] + x + x[: r.randrange(len(x))]
    a, b = ["a"], ["a", "b"]  # Fibonacci words have the most runs
    for _ in range(r.randrange(8)):
        a, b = b, b + a
    return b * r.randrange(1, 4)


@pytest.mark.parametrize("rounds", [0, 1, 48])
def test_runs_of_random_words(monkeypatch, rounds):
    monkeypatch.setattr(periodic_runs, "ROUNDS", rounds)
    monkeypatch.setattr(periodic_runs, "TRIED", 50)
    r = random.Random(rounds)
    for _ in range(300):
        docs = [some_words(r) for _ in range(r.randrange(1, 5))]
        symbols, first = [(d, x) for d, words in enumerate(docs) for x in words], np.cumsum([0] + [len(w) for w in docs])
        number = {x: i for i, x in enumerate(sorted(set(symbols)))}
        for exponent, least in ((4, 6), (2, 1), (3, 4)):
            got = periodic_runs.all_runs(np.array([number[x] for x in symbols], np.int64), first, least, exponent)
            assert got.tolist() == [[s + first[d], s + m + first[d], q] for d, words in enumerate(docs) for s, m, q in plain_runs(words, least, exponent)]


def plain_digest(doc_id, text):
    words = brute.WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    s, m, q = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
    told = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return doc_id, len(runs), s, m, q, 1000 * m // q if runs else None, brute.sha(told), brute.sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_runs_digest(spark, rows):
    r = random.Random(8)
    more = [(1000 + i, " \n".join(some_words(r))) for i in range(120)] + [(2000, "\t" + "ab c " * 200), (2001, "é x\u0085 " * 9), (2002, "a " * 5 + "b"), (2003, "a " * 6)]
    found = Counter(tuple(x) for x in periodic_runs.runs_digest(frame(spark, rows + more).repartition(3)).collect())
    assert found == Counter(plain_digest(d, t) for d, t in rows + more)
    assert periodic_runs.runs_digest(frame(spark, [])).collect() == []


def test_runs_of_a_long_text(spark):
    text = " ".join(f"w{i}" for i in range(300_000)) + " ab c" * 200_000 + " " + " ".join(f"w{i}" for i in range(100_000))
    x = periodic_runs.periodic_runs(frame(spark, [(1, text), (2, "b")])).where("doc_id = 1").collect()[0]
    assert ([tuple(y) for y in x["runs"]], x["n_words"], x["n_dropped"]) == ([(300_000, 400_000, 2)], 800_000, 399_998)


def test_runs_themselves(spark):
    x = periodic_runs.periodic_runs(frame(spark, [(1, "so we go we go we go we go on")]), least=4, exponent=3).collect()[0]
    assert (x["n_words"], x["n_dropped"], [tuple(y) for y in x["runs"]], x["collapsed"]) == (10, 6, [(1, 8, 2)], "so we go on")
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(frame(spark, []), exponent=1)


# SimHash.


def plain_print(text):
    words = brute.WORD.findall((text or "").translate(brute.LOW))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * (len(words) > 0)
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_labels(prints, most=3):
    a, label = np.array(prints, np.uint64), np.arange(len(prints))
    links = [np.flatnonzero(np.bitwise_count(a ^ x) <= most) for x in a]
    while True:
        new = np.array([label[own].min() for own in links])
        if (new == label).all():
            return label.tolist()
        label = new


@pytest.mark.parametrize("checks", [3, 4, 5])
def test_codes_cover(checks):
    v = np.random.default_rng(1).integers(0, 1 << ((1 << checks) - 1), 500) if checks > 3 else np.arange(128)
    place, code, home = simhash_anchors.anchors(v, checks)
    far = np.bitwise_count(v[place] ^ code)
    assert (simhash_anchors.syndrome(code, checks) == 0).all() and sorted(place[home].tolist()) == list(range(len(v))) and far[home].max() == 1
    assert far.max() == 2
    if checks == 3:  # all code words within 2 are there
        words = np.flatnonzero(simhash_anchors.syndrome(np.arange(128), 3) == 0)
        assert Counter(zip(v[place].tolist(), code.tolist())) == Counter((x, int(c)) for x in range(128) for c in words if (x ^ int(c)).bit_count() <= 2)


@pytest.mark.parametrize("hot", [1, 3, 4096])
def test_simhash_classes(spark, rows, hot):
    found = simhash_anchors.simhash_classes(frame(spark, rows).repartition(3), hot).collect()
    prints = [plain_print(t) for _, t in rows]
    least = {}
    labels = plain_labels(prints)
    for (d, _), c in zip(rows, labels):
        if d is not None:
            least[c] = min(least.get(c, d), d)
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in found) == Counter((d, f, least.get(c)) for (d, _), f, c in zip(rows, prints, labels))


@pytest.mark.parametrize("hot", [0, 20, 4096])
def test_crowded_anchors(spark, hot):
    """Fingerprints around few centres, so that anchors of every level are hot."""
    r = random.Random(hot)
    centres = [r.getrandbits(64) for _ in range(3)] + [0, (1 << 64) - 1]
    prints = set()
    for _ in range(1500):
        x = r.choice(centres)
        for _ in range(r.choice((0, 1, 2, 3, 5, 9))):
            x ^= 1 << r.randrange(64)
        prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash_anchors._links(spark.createDataFrame([(p,) for p in signed], "fp long").repartition(3), hot).collect()
    place = {p: i for i, p in enumerate(signed)}
    a, b = (np.array([place[x[c]] for x in links], np.int64) for c in ("u", "v"))
    assert simhash_anchors.join_classes(np.arange(len(prints)), a, b).tolist() == plain_labels(prints)


def test_simhash_digest(spark):
    rows = [(5, None), (3, " \n"), (9, "one two"), (4, "ONE\ttwo"), (8, "x " * 200_000)]
    found = {x["doc_id"]: (x["fingerprint"], x["component_id"]) for x in simhash_anchors.simhash_digest(frame(spark, rows)).collect()}
    assert found == {d: (f"{plain_print(t):016x}", {5: 3, 3: 3, 9: 4, 4: 4, 8: 8}[d]) for d, t in rows}
    assert simhash_anchors.simhash_digest(frame(spark, [])).collect() == []
