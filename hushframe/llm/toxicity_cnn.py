"""Toxicity by a convolutional text classifier trained in numpy.

Words (ASCII letters lower-cased) are hashed twice into embedding tables, and so are
their beginnings of five and of seven bytes, so that inflected and compounded forms of a
word that was never seen share what was learned; a word's vector is the sum of its rows,
so one colliding row alone doesn't carry a verdict.  Filters of several widths slide over the whole text, ReLU and max pooling
follow, then a logistic layer.

Training rows: all that may be learned from.  Up to ``TrainLimits.max_rows`` of them one
task fits.  Of more, as many by hash give a start (where it has fewer than ``toxic_rows``
toxic rows, the next toxic ones by hash join it), and one pass over every row, in shards
whose changes are averaged, moves it; a fifth of all by hash is kept out of both, and
calibrates.  For few rows:
A fifth of each class is kept out of the fit to stop it and to calibrate one threshold
a language: the smallest score from ``floor`` up with at least ``precision`` on those
rows.  A language without ``min_positives`` there or without such a score uses the
threshold found over all languages together, and that is ``floor`` where these have none.

Defined results: null and empty texts get the score of the bias alone.  Without any
usable labelled row the score is 0 everywhere.  Rows with null ids are scored, repeated
rows give a row each, an empty table none; a null language has the threshold of all.
Very long texts are scored whole.  Other columns stay or are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, SparkContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textbatch import LOWER, U64, Words, buffers, frugal, id_fold, map_pieces, mix, pick, pieces, positional, range_hashes, small_batches

#: Rows of a word: twice the word itself, then its beginnings of so many bytes.
BEGINNINGS = (None, None, 5, 7)
HASHES = len(BEGINNINGS)
#: Rows of a table that travel together; steps of the score in which rows are counted.
_BLOCK, _STEPS = 1024, 4096
#: Bits of a bitmap of ids (Spark's own size), bits for each id, and most bitmaps: 8 MB.
_BITMAP, _BITS_EACH, _MOST_BITMAPS = 1 << 15, 8, 1 << 11


@dataclass(frozen=True)
class TrainLimits:
    """``max_rows`` labelled rows (and toxic ones up to ``toxic_rows``) and at most
    ``max_bytes`` of text are fitted in one task: whole texts in order of hash, without those
    that don't fit into what is left.  Where that isn't all, it is the start of a pass over
    every row, in shards of some ``shard_rows``."""

    max_rows: int = 5000
    max_bytes: int = 32 << 20
    buckets: int = 1 << 16
    dims: int = 12
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 16
    epochs: int = 30
    batch: int = 160
    rate: float = 0.02
    decay: float = 1e-4
    min_count: int = 2
    floor: float = 0.3
    precision: float = 0.8
    min_positives: int = 15
    toxic_rows: int = 500
    shard_rows: int = 4096


@dataclass
class ToxicityModel:
    """``embed[k]``: bucket x dims; ``conv[w][j]``: dims x filters for width w and offset j."""

    embed: list[np.ndarray]
    conv: list[list[np.ndarray]]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.3
    sent: tuple[SparkContext, Broadcast] | None = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"sent": None}

    def shared(self, spark: SparkSession) -> Broadcast:
        """The model's broadcast, some 13 MB whatever the input, made once for all that score
        with its numbers.  Thresholds may be set later, so they travel beside it."""
        if self.sent is None or self.sent[0] is not spark.sparkContext:
            self.sent = spark.sparkContext, spark.sparkContext.broadcast(self)
        return self.sent[1]

    def cuts(self) -> Callable[[pa.Array], np.ndarray]:
        """The thresholds of languages, as a function that holds nothing else of the model."""
        of, otherwise = dict(self.thresholds), self.threshold
        return lambda langs: np.array([of.get(x or "", otherwise) for x in langs.to_pylist()])

    def score(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        vectors = word_vectors(self.embed, buckets)
        pooled = [pool(vectors, width, b, first)[0] for width, b in zip(self.conv, self.biases)]
        z = np.concatenate(pooled, axis=1) @ self.out + self.out_bias
        return 1 / (1 + np.exp(-z.astype(np.float64)))


def word_vectors(embed: list[np.ndarray], buckets: np.ndarray) -> np.ndarray:
    out = embed[0][buckets[0]]
    for table, rows in zip(embed[1:], buckets[1:]):
        out += table[rows]
    return out


def word_buckets(batch_texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed rows (hash x word) of a piece's words, and each document's first word."""
    buf, offs = buffers(batch_texts)
    buf = LOWER[buf]
    words = Words(buf, offs)
    rows = []
    for k, most in enumerate(BEGINNINGS):
        h = words.hash if most is None else range_hashes(buf, words.start, np.minimum(words.end, words.start + most))
        rows.append((mix(h + U64(977 * k + 1)) % U64(buckets)).astype(np.int32))
    return np.stack(rows), words.first


def pool(vectors: np.ndarray, width: list[np.ndarray], bias: np.ndarray, first: np.ndarray, where: bool = False):
    """Max over a document's positions of each filter; positions past its end are padding."""
    n, docs = len(vectors), len(first) - 1
    act = np.zeros((n, len(bias)), np.float32)
    for j, filters in enumerate(width):
        part = vectors @ filters
        if j < n:
            act[: n - j] += part[j:]
        if j and n:
            # the last j words of a document have no word at offset j
            size = np.diff(first)
            for back in range(1, j + 1):
                ends = (first[1:] - back)[size >= back]
                over = ends + j
                over = over[over < n]
                act[over - j] -= part[over]
    top = np.full((docs, len(bias)), -bias, np.float32)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        top[full] = np.maximum.reduceat(act, first[full], axis=0)
    pooled = np.maximum(top + bias, 0)
    if not where:
        return pooled, None
    at = np.full((docs, len(bias)), -1, np.int64)
    if len(full):
        hit = act == np.repeat(top[full], np.diff(first)[full], axis=0)
        spot = np.where(hit, np.arange(n)[:, None], n)
        at[full] = np.minimum.reduceat(spot, first[full], axis=0)
    at[pooled <= 0] = -1
    return pooled, at


class _Adam:
    def __init__(self, values: list[np.ndarray], rate: float):
        self.values, self.rate, self.t = values, rate, 0
        self.m, self.v = [np.zeros_like(x) for x in values], [np.zeros_like(x) for x in values]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for x, g, m, v in zip(self.values, grads, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= scale * m / (np.sqrt(v) + 1e-8)


def gradients(embed: list[np.ndarray], conv: list[list[np.ndarray]], biases: list[np.ndarray], out: np.ndarray, out_bias: np.ndarray, buckets: np.ndarray, first: np.ndarray, labels: np.ndarray, limits: TrainLimits, live: np.ndarray | None = None) -> list[np.ndarray]:
    """Gradients of a batch's mean loss, in the order of ``_Adam``'s values."""
    n_filters = len(biases[0])
    vectors = word_vectors(embed, buckets)
    pooled, spots = zip(*[pool(vectors, conv[w], biases[w], first, True) for w in range(len(conv))])
    joined = np.concatenate(pooled, axis=1)
    p = 1 / (1 + np.exp(-(joined @ out + out_bias[0])))
    gz = ((p - labels) / len(labels)).astype(np.float32)
    g_embed, g_conv, g_bias = [np.zeros_like(e) for e in embed], [], []
    for w, width in enumerate(conv):
        gp = gz[:, None] * out[w * n_filters : (w + 1) * n_filters]
        live_spot = spots[w] >= 0
        gp = gp * live_spot
        g_bias.append(gp.sum(0))
        d, f = np.nonzero(live_spot)
        at, g = spots[w][d, f], gp[d, f]
        for j, c in enumerate(width):
            inside = at + j < first[d + 1]
            gc = np.zeros_like(c)
            ff, gg = f[inside], g[inside]
            for k in range(HASHES):
                b = buckets[k, at[inside] + j]
                np.add.at(gc.T, ff, gg[:, None] * embed[k][b])
                np.add.at(g_embed[k], b, gg[:, None] * c.T[ff])
            g_conv.append(gc + limits.decay * c)
    for k in range(HASHES):
        g_embed[k] += 1e-6 * embed[k]
        if live is not None:
            g_embed[k] *= live[k][:, None]
    return [*g_embed, *g_conv, *g_bias, joined.T @ gz + limits.decay * out, np.array([gz.sum()], np.float32)]


def fit(texts: pa.Array, labels: np.ndarray, langs: list[str | None], limits: TrainLimits = TrainLimits(), toxic_weight: float = 1.0) -> ToxicityModel:
    """Train on labelled whole texts.  ``toxic_weight``: how many toxic rows a sampled
    one stands for, against the clean ones."""
    rng = np.random.default_rng(7)
    n_rows, n_filters = len(labels), limits.filters
    if not n_rows or labels.min() == labels.max():
        empty = [np.zeros((limits.buckets, limits.dims), np.float32)] * HASHES
        conv = [[np.zeros((limits.dims, n_filters), np.float32)] * w for w in limits.widths]
        rate = float(labels.mean()) if n_rows else 0.0
        bias = -40.0 if rate == 0 else float(min(40, np.log(rate + 1e-9) - np.log(1 - rate + 1e-9)))
        return ToxicityModel(empty, conv, [np.zeros(n_filters, np.float32)] * len(limits.widths), np.zeros(n_filters * len(limits.widths), np.float32), bias)
    table = pa.table({"text": texts}).combine_chunks().to_batches()
    docs: list[np.ndarray] = []
    for batch in table:
        for piece in pieces(batch):
            b, first = word_buckets(piece.column(0), limits.buckets)
            docs += [b[:, first[i] : first[i + 1]] for i in range(len(first) - 1)]
    # rows of the tables that too few training texts use stay at zero
    count = np.zeros((HASHES, limits.buckets), np.int32)
    for d in docs:
        for k in range(HASHES):
            count[k, np.unique(d[k])] += 1
    live = count >= limits.min_count
    fold = rng.permutation(n_rows)
    clean, toxic = fold[labels[fold] <= 0], fold[labels[fold] > 0]
    # few toxic rows: as many as calibration needs, if that leaves as many to learn from
    kept_out = len(toxic) // 5 if len(toxic) < 2 * limits.min_positives else max(len(toxic) // 5, limits.min_positives)
    held = np.concatenate([clean[: len(clean) // 5], toxic[:kept_out]])
    train = np.concatenate([clean[len(clean) // 5 :], toxic[kept_out:]])
    weights = np.where(labels[held] > 0, toxic_weight * len(toxic) / max(1, kept_out), len(clean) / max(1, len(clean) // 5))
    embed = [(rng.normal(0, 0.1, (limits.buckets, limits.dims)) * live[k][:, None]).astype(np.float32) for k in range(HASHES)]
    conv = [[rng.normal(0, 0.3, (limits.dims, n_filters)).astype(np.float32) for _ in range(w)] for w in limits.widths]
    biases = [np.zeros(n_filters, np.float32) for _ in limits.widths]
    out = rng.normal(0, 0.1, n_filters * len(limits.widths)).astype(np.float32)
    out_bias = np.full(1, np.log(labels.mean() / (1 - labels.mean())), np.float32)
    flat = [x for w in conv for x in w]
    adam = _Adam([*embed, *flat, *biases, out, out_bias], limits.rate)

    def gathered(rows):
        size = np.array([docs[r].shape[1] for r in rows])
        return np.concatenate([docs[r] for r in rows], axis=1), np.concatenate([[0], np.cumsum(size)])

    def model():
        return ToxicityModel([e.copy() for e in embed], [[c.copy() for c in w] for w in conv], [b.copy() for b in biases], out.copy(), float(out_bias[0]))

    def held_scores(m):
        parts = [m.score(*gathered(held[i : i + 512])) for i in range(0, len(held), 512)]
        return np.concatenate(parts) if parts else np.zeros(0)

    best, best_loss, bad = None, np.inf, 0
    for _ in range(limits.epochs if len(train) > 2000 else limits.epochs * 3):
        rng.shuffle(train)
        for i in range(0, len(train), limits.batch):
            rows = train[i : i + limits.batch]
            adam.step(gradients(embed, conv, biases, out, out_bias, *gathered(rows), labels[rows], limits, live))
        now = model()
        s = np.clip(held_scores(now), 1e-6, 1 - 1e-6)
        y = labels[held]
        loss = float(-(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()) if len(held) else 0.0
        if loss < best_loss - 1e-4:
            best, best_loss, bad = now, loss, 0
        else:
            bad += 1
            if bad >= 4:
                break
    best = best or model()
    scores = held_scores(best)
    names = np.array([x or "" for x in langs], object)[held]
    best.threshold = threshold(scores, labels[held], limits, limits.floor, weights)
    for lang in map(str, np.unique(names.astype(str))):
        of = names == lang
        best.thresholds[lang] = threshold(scores[of], labels[held][of], limits, best.threshold, weights[of])
    return best


def threshold(scores: np.ndarray, labels: np.ndarray, limits: TrainLimits, otherwise: float, weights: np.ndarray | None = None, times: np.ndarray | int = 1) -> float:
    """Smallest score from ``floor`` up whose rows at or above it are positives by
    ``precision`` of their weight at least; ``otherwise`` where there is none or the rows
    have fewer than ``min_positives``.  ``times``: how many rows one stands for there."""
    if (labels * times).sum() < limits.min_positives:
        return otherwise
    order = np.argsort(-scores, kind="stable")
    ranked = scores[order]
    weight = np.ones(len(order)) if weights is None else weights[order]
    good = np.cumsum(labels[order] * weight) >= limits.precision * np.cumsum(weight)
    last = np.append(ranked[1:] != ranked[:-1], True)  # equal scores fall on one side
    fine = ranked[good & last & (ranked >= limits.floor)]
    return float(fine.min()) if len(fine) else otherwise


def train_toxicity(docs: DataFrame, labels: DataFrame, limits: TrainLimits = TrainLimits()) -> ToxicityModel:
    """Fit on all labelled texts of documents whose crc32(doc_id as text) mod 4 is not 2.

    Where they are at most ``max_rows`` and ``max_bytes``, one task fits them.  Else one task
    fits a start on as many by hash (a bounded top-k, so partial limits run before any
    exchange), every labelled text then moves it (``refined``), but for a fifth by hash that
    no fit sees, and all of these set the thresholds (``calibrated``)."""
    known = (
        pick(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").where(F.coalesce(id_fold(F.col("doc_id"), 4), F.lit(2)) != 2)
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    )
    texts = pick(docs, "doc_id", "text", "lang").where("text is not null").withColumn("size", F.octet_length("text"))
    model, whole = _start(texts, known, limits)
    if whole:
        return model
    kept_out = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(5)) == 0
    model, _ = _start(texts, known.where(~kept_out), limits, True)
    likely = _likely(texts.select("doc_id", "text", "lang"), known)
    model = refined(model, likely.where(~kept_out), limits, known)
    return calibrated(model, likely.where(kept_out), limits, known)


def _likely(texts: DataFrame, known: DataFrame) -> DataFrame:
    """The texts whose ids may be among the known ones, by bitmaps of their hashes: few others
    pass, and only what passes is shuffled or scored.  Above some 8 million ids the bitmaps
    fill up and more others pass.  Ids that a join would have to cast all pass."""
    kind = known.schema["doc_id"].dataType
    if texts.schema["doc_id"].dataType != kind or not (isinstance(kind, T.IntegralType) or kind == T.StringType()):
        return texts
    maps = min(_MOST_BITMAPS, max(1, -(-known.count() * _BITS_EACH // _BITMAP)))
    h = F.xxhash64(F.lit("known"), "doc_id")
    at, of = F.shiftrightunsigned(h, 40).bitwiseAND(_BITMAP - 1), F.pmod(h, F.lit(maps))
    bits = known.groupBy(of.alias("of")).agg(F.bitmap_construct_agg(at).alias("bits"))
    byte = F.conv(F.hex(F.substring(F.col("bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hashed = texts.withColumn("of", of).join(F.broadcast(bits), "of")
    return hashed.where(F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1).select(*texts.columns)


def _start(texts: DataFrame, known: DataFrame, limits: TrainLimits, part: bool = False) -> tuple[ToxicityModel | None, bool]:
    """The model of the first labelled texts by hash and whether these are all; without
    ``part`` there is no model where they aren't.  The texts meet in one task, which trains,
    so the driver only holds the model."""
    spark = texts.sparkSession
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    rows = known.orderBy(*by_hash).limit(limits.max_rows + 1).collect()
    whole, rows = len(rows) <= limits.max_rows, rows[: limits.max_rows]
    if not whole and not part:
        return None, False
    toxic_weight, n_hash, n_toxic = 1.0, len(rows), sum(r[1] == 1 for r in rows)
    if not whole and n_toxic < limits.toxic_rows:
        more = known.where("toxic = 1").orderBy(*by_hash).limit(limits.toxic_rows).collect()
        of_all = known.agg(F.count("*"), F.count(F.when(F.col("toxic") == 1, 1))).first()
        # toxic and clean labelled rows that a row of each stands for
        stands = of_all[1] / max(1, len(more)), (of_all[0] - of_all[1]) / max(1, len(rows) - n_toxic)
        toxic_weight = stands[0] / max(stands[1], 1e-9) if more else 1.0
        taken = {r[0] for r in rows}
        rows += [r for r in more if r[0] not in taken]
    if not rows:
        return fit(pa.array([], pa.string()), np.zeros(0, np.float32), [], limits), whole
    chosen = pd.DataFrame({"doc_id": [r[0] for r in rows], "toxic": [r[1] for r in rows], "place": np.concatenate([np.arange(n) / max(1, n) for n in (n_hash, len(rows) - n_hash)])})
    # where the bytes run out, rows by hash and added toxic ones end in proportion
    sizes = texts.select("doc_id", "size").join(F.broadcast(spark.createDataFrame(chosen)), "doc_id").groupBy("place", "doc_id", "size").count().toPandas()
    sizes["room"] = sizes["size"] * sizes["count"]
    sizes = sizes.sort_values(["place", "size"])
    fits = fitting(sizes["room"].to_numpy(), limits.max_bytes)
    if not fits.all():
        whole = False
        if not part:
            return None, False
    if not fits.any():
        return fit(pa.array([], pa.string()), np.zeros(0, np.float32), [], limits), whole
    small = F.broadcast(spark.createDataFrame(sizes.loc[fits, ["doc_id", "size"]].merge(chosen[["doc_id", "toxic"]], "left", "doc_id")))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(batches).combine_chunks()
        got = got.take(pc.sort_indices(got, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))
        model = fit(got["text"].combine_chunks(), got["toxic"].to_numpy().astype(np.float32), got["lang"].to_pylist(), limits, toxic_weight)
        yield pa.record_batch({"model": pa.array([pickle.dumps(model)], pa.binary())})

    small_batches(spark)
    got = texts.join(small, ["doc_id", "size"]).select("doc_id", "text", "lang", "toxic").repartition(1)
    return pickle.loads(got.mapInArrow(frugal(learn), "model binary").toArrow()["model"][0].as_py()), whole


def _values(m: ToxicityModel) -> list[np.ndarray]:
    """The model's numbers in the order of ``gradients``."""
    return [*m.embed, *[x for w in m.conv for x in w], *m.biases, m.out, np.full(1, m.out_bias, np.float32)]


def _sharded(texts: DataFrame, known: DataFrame, shards: int) -> DataFrame:
    """Text and label of the texts that ``known`` labels, dealt and sorted by hash.  Labels are
    dealt with the texts and spread over their id's rows, so that texts are shuffled once; a
    join would shuffle them as well where the labels are too many for a broadcast."""
    if texts.schema["doc_id"].dataType != known.schema["doc_id"].dataType:  # the join casts
        known = texts.select("doc_id").distinct().join(known, "doc_id")
    key = F.xxhash64(F.lit("shard"), "doc_id").alias("h"), "doc_id"
    rows = texts.where("doc_id is not null").select(*key, "text", F.lit(None).cast(known.schema["toxic"].dataType).alias("toxic"))
    both = rows.union(known.select(*key, F.lit(None).cast("string"), "toxic")).repartition(shards, "h")
    labelled = both.select("h", "text", F.max("toxic").over(Window.partitionBy("h", "doc_id")).alias("toxic"))
    return labelled.where("text is not null and toxic is not null").sortWithinPartitions("h", "text").select("text", "toxic")


def refined(model: ToxicityModel, texts: DataFrame, limits: TrainLimits, known: DataFrame) -> ToxicityModel:
    """The model after one pass of all texts that ``known`` labels: shards by hash of some
    ``shard_rows`` rows start from it, take Adam's steps in order of hash, and their changes
    are averaged, a row of a table over the shards whose texts use it.  Texts are shuffled
    once, into their shards, where labels meet them.  Tables travel in blocks of rows, so no
    task holds more than a shard's model or a block of every shard."""
    if not any(x.any() for x in model.embed):  # one class only: nothing to learn from
        return model
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(model)
    shards = max(1, -(-texts.select("doc_id").join(known, "doc_id").count() // limits.shard_rows))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = [x.astype(np.float32) for x in _values(shared.value)]
        values = [x.copy() for x in start]
        widths = [len(w) for w in shared.value.conv]
        embed, rest = values[:HASHES], values[HASHES:]
        flat, biases, (out, out_bias) = rest[: sum(widths)], rest[sum(widths) : -2], rest[-2:]
        conv = [flat[sum(widths[:i]) : sum(widths[: i + 1])] for i in range(len(widths))]
        adam = _Adam(values, limits.rate)
        few = max(1, limits.batch // 5)  # one pass needs more steps than the start's many
        used = np.zeros((HASHES, limits.buckets), bool)
        held: list[tuple[np.ndarray, float]] = []
        seen = 0

        def step() -> None:
            size = [d.shape[1] for d, _ in held]
            buckets = np.concatenate([d for d, _ in held], axis=1)
            for k in range(HASHES):
                used[k, buckets[k]] = True
            labels = np.array([y for _, y in held], np.float32)
            adam.step(gradients(embed, conv, biases, out, out_bias, buckets, np.concatenate([[0], np.cumsum(size)]), labels, limits, used))
            held.clear()

        for batch in batches:
            for piece in pieces(batch):
                b, first = word_buckets(piece.column(piece.schema.get_field_index("text")), limits.buckets)
                held += [(b[:, first[i] : first[i + 1]], float(y)) for i, y in enumerate(piece.column(piece.schema.get_field_index("toxic")).to_pylist())]
                seen += piece.num_rows
                while len(held) >= few:
                    later = held[few:]
                    del held[few:]
                    step()
                    held += later
                if sum(d.shape[1] for d, _ in held) > 1 << 20:  # very long texts
                    step()
        if held:
            step()
        if not seen:
            return
        for k in range(HASHES):
            for at in range(0, limits.buckets, _BLOCK):
                n = used[k, at : at + _BLOCK].astype(np.float32)
                if n.any():
                    change = (embed[k] - start[k])[at : at + _BLOCK] * n[:, None]
                    yield pa.record_batch({"value": pa.array([k], pa.int32()), "at": pa.array([at], pa.int32()), "n": pa.array([n.tobytes()], pa.binary()), "change": pa.array([change.tobytes()], pa.binary())})
        for i in range(HASHES, len(values)):
            weight = np.full(1, seen, np.float32)  # shards' sizes differ a little
            change = (values[i] - start[i]) * weight
            yield pa.record_batch({"value": pa.array([i], pa.int32()), "at": pa.array([0], pa.int32()), "n": pa.array([weight.tobytes()], pa.binary()), "change": pa.array([change.tobytes()], pa.binary())})

    def added(table: pa.Table) -> pa.Table:
        n, change = 0.0, 0.0
        for a, b in zip(table["n"], table["change"]):
            n, change = n + np.frombuffer(a.as_py(), np.float32), change + np.frombuffer(b.as_py(), np.float32)
        return pa.table({"value": table["value"][:1], "at": table["at"][:1], "n": pa.array([n.tobytes()], pa.binary()), "change": pa.array([change.tobytes()], pa.binary())})

    small_batches(spark)
    schema = "value int, at int, n binary, change binary"
    changes = _sharded(texts, known, shards).mapInArrow(frugal(learn), schema).groupBy("value", "at").applyInArrow(added, schema).toArrow()  # the size of the model
    shared.destroy()
    values = [x.astype(np.float32) for x in _values(model)]
    for value, at, n, change in zip(*(changes[c].to_pylist() for c in changes.column_names)):
        n, change = np.frombuffer(n, np.float32), np.frombuffer(change, np.float32)
        if value < HASHES:
            values[value][at : at + len(n)] += change.reshape(len(n), -1) / np.maximum(n, 1)[:, None]
        else:
            values[value] += (change / n[0]).reshape(values[value].shape)
    widths = [len(w) for w in model.conv]
    conv = iter(values[HASHES : HASHES + sum(widths)])
    return ToxicityModel(values[:HASHES], [[next(conv) for _ in range(w)] for w in widths], values[HASHES + sum(widths) : -2], values[-2], float(values[-1][0]), model.thresholds, model.threshold)


def calibrated(model: ToxicityModel, texts: DataFrame, limits: TrainLimits, known: DataFrame | None = None) -> ToxicityModel:
    """The model with thresholds of all these rows, counted by language and score in steps of
    ``1 / _STEPS``; a row counts once.  Labels are the texts' own or come from ``known``,
    which the scores join by id: no text is shuffled."""
    shared = model.shared(texts.sparkSession)
    key = "toxic" if known is None else "doc_id"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = shared.value.score(*word_buckets(batch.column(0), limits.buckets))
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(np.floor(score * _STEPS).astype(np.int32)), batch.column(2)], names=["lang", "step", key])

    source = texts.select("text", F.coalesce("lang", F.lit("")).alias("lang"), key)
    scored = map_pieces(source, run, f"lang string, step int, {key} {source.schema[key].dataType.simpleString()}")
    scored = scored if known is None else scored.join(known, "doc_id")
    # below the floor only positives' number matters
    counted = scored.select("lang", F.greatest("step", F.lit(int(limits.floor * _STEPS) - 1)).alias("step"), F.col("toxic").cast("int").alias("toxic")).groupBy("lang", "step", "toxic").count().toPandas()
    steps, toxic, n = counted["step"].to_numpy() / _STEPS, (counted["toxic"].to_numpy() > 0).astype(float), counted["count"].to_numpy()
    model.threshold = threshold(steps, toxic, limits, limits.floor, n, n)
    model.thresholds = {}
    for lang in sorted(set(counted["lang"])):
        of = (counted["lang"] == lang).to_numpy()
        model.thresholds[lang] = threshold(steps[of], toxic[of], limits, model.threshold, n[of], n[of])
    return model


def fitting(sizes: np.ndarray, most: int) -> np.ndarray:
    """Which of these, taken in order, fit into what is left of ``most``."""
    fits, left = np.zeros(len(sizes), bool), most
    for i, size in enumerate(sizes):
        if size <= left:
            fits[i], left = True, left - size
    return fits


def score_toxicity(docs: DataFrame, model: ToxicityModel, limits: TrainLimits = TrainLimits()) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.3), toxic (score at or above the
    language's calibrated threshold).  The language only picks the threshold."""
    shared, cuts = model.shared(docs.sparkSession), model.cuts()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = shared.value.score(*word_buckets(batch.column(1), limits.buckets))
        cut = cuts(batch.column(2))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(3), pa.array(score), pa.array((score >= 0.3).astype(np.int32)), pa.array(score >= cut)],
            names=["doc_id", "held_out", "score", "predicted", "toxic"],
        )

    source = pick(docs, "doc_id", "text", "lang").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", F.coalesce(id_fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    )
    return map_pieces(source, run, "doc_id long, held_out boolean, score double, predicted int, toxic boolean")


def reject_toxic(docs: DataFrame, model: ToxicityModel, limits: TrainLimits = TrainLimits()) -> DataFrame:
    """Documents below their language's threshold; columns stay, whatever their names, and
    nothing is shuffled."""
    shared, cuts = model.shared(docs.sparkSession), model.cuts()
    flat, place = positional(docs)
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = shared.value.score(*word_buckets(batch.column(text), limits.buckets))
        return batch.filter(pa.array(score < cuts(batch.column(lang))))

    kept = map_pieces(flat, run, flat.schema, place["text"])
    return kept.select(*[F.col(place[i]).alias(c) for i, c in enumerate(docs.columns)])
