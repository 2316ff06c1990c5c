"""Language identification by prediction by partial matching.

For each language a variable-order byte context tree (orders 3 to 0) is counted on
training texts; escapes are PPM method C with exclusion: a symbol seen n times in a
context of t symbols and d kinds has n / (t + d) there, the rest goes on to the next
shorter context without the kinds already seen, at last to the 256 byte values.
Statistics are frozen after training, so the code length of a byte after a context is
a number; they are all written to one table (context x byte class x language) and a
text's exact code length is a sum of gathers over all its bytes.  Bytes that no
training text holds behave alike and share a class; this doesn't change any length.
Every language of the table is learned.  Languages share a table in groups of bounded
size, and executors read many groups one at a time, so memory doesn't grow with them.

``score`` is the posterior of the best language with equal priors on the mean code
length (bits a byte, times ``sharpness``).

Defined results: null text or text without a letter gives ``und`` and score 0, as
does every text if no language could be learned.  Ties go to the first language by name.
Repeated rows and null ids give a row each, an empty table none; very long texts are read
whole (only the training sample is cut); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textbatch import broadcast_rows, buffers, id_fold, map_pieces, pick

ORDER = 3


@dataclass(frozen=True)
class PpmLimits:
    """Training sample: ``docs_per_lang`` documents of each language, by hash, and
    ``bytes_per_lang`` of each: longer texts give their first bytes, so that all take part; the driver reads samples of ``langs_per_read`` languages
    at once.  A table has ``group_langs`` languages and about ``group_bytes`` at most (one
    language may need more); a worker keeps ``kept_bytes`` of tables in memory."""

    docs_per_lang: int = 300
    bytes_per_lang: int = 1 << 20
    langs_per_read: int = 64
    group_langs: int = 8
    group_bytes: int = 96 << 20
    kept_bytes: int = 192 << 20
    sharpness: float = 24.0


@dataclass
class PpmModel:
    langs: list[str]
    classes: np.ndarray  # byte -> class, 0 for bytes never trained on
    row: np.ndarray  # three classes -> row of ``bits``
    bits: np.ndarray  # (row * classes + class) x language

    def code_lengths(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Bits of each document under each language."""
        docs, a = len(offs) - 1, int(self.classes.max()) + 1
        total = np.zeros((docs, len(self.langs)))
        full = np.flatnonzero(np.diff(offs) > 0)
        if not len(full):
            return total
        s = self.classes[buf].astype(np.int32)
        starts = offs[full]
        past = []
        for back in range(1, ORDER + 1):
            p = np.zeros_like(s)
            p[back:] = s[:-back] if back < len(s) else 0
            for lead in range(back):
                at = starts + lead
                p[at[at < len(s)]] = 0
            past.append(p)
        # a short text's cells past its end belong to the next one, which also clears them
        row = self.row[(past[2] * a + past[1]) * a + past[0]]
        cost = self.bits[row.astype(np.int64) * a + s]
        total[full] = np.add.reduceat(cost, starts, axis=0, dtype=np.float64)
        return total


@dataclass
class PpmModels:
    """All languages by name; each group's columns among them and its broadcast PpmModel."""

    langs: list[str]
    groups: list[tuple[list[int], Broadcast]]
    size: int = 0

    def code_lengths(self, buf: np.ndarray, offs: np.ndarray, kept_bytes: int = PpmLimits.kept_bytes) -> np.ndarray:
        """Bits of each document under each language."""
        total = np.zeros((len(offs) - 1, len(self.langs)))
        for columns, shared in self.groups:
            total[:, columns] = shared.value.code_lengths(buf, offs)
            if self.size > kept_bytes:
                vars(shared).pop("_value", None)  # read from its local file again for the next piece
        return total


def _levels(s: np.ndarray, a: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per order: sorted (context, symbol) codes and their counts; class 0 marks text ends."""
    out = []
    for order in range(ORDER + 1):
        code = np.zeros(max(0, len(s) - order), np.int64)
        for j in range(order + 1):
            code = code * a + s[j : len(s) - order + j]
        if order:
            keep = np.ones(len(code), bool)
            for j in range(order + 1):
                keep &= s[j : len(s) - order + j] > 0
            code = code[keep]
        else:
            code = code[code > 0]
        out.append(np.unique(code, return_counts=True))
    return out


def _bits(contexts: np.ndarray, orders: np.ndarray, levels, a: int, seen_bytes: int) -> np.ndarray:
    """Code length in bits of every class after each context; ``orders``: symbols of
    the context that count, lower orders take its last ones."""
    n = len(contexts)
    excluded = np.zeros((n, a), bool)
    left = np.ones(n)
    p = np.zeros((n, a))
    for order in range(ORDER, -1, -1):
        codes, counts = levels[order]
        use = np.flatnonzero(orders >= order)
        if not len(use) or not len(codes):
            continue
        tail = contexts[use] % (a**order)
        keys, inverse = np.unique(tail, return_inverse=True)
        dense = np.zeros((len(keys), a), np.int32)
        of = np.searchsorted(keys, codes // a)
        ok = (of < len(keys)) & (keys[np.minimum(of, len(keys) - 1)] == codes // a)
        dense[of[ok], (codes % a)[ok]] = counts[ok]
        c = dense[inverse] * ~excluded[use]
        t, d = c.sum(1), (c > 0).sum(1)
        has = t > 0
        total = np.where(has, t + d, 1)
        p[use] += left[use, None] * c / total[:, None]
        left[use] = np.where(has, left[use] * d / total, left[use])
        excluded[use] |= c > 0
    rest = 256 - excluded.sum(1)
    tail = left / rest
    p = np.where(excluded, p, tail[:, None])
    return -np.log2(np.maximum(p, 1e-300)).astype(np.float32)


def fit(texts: dict[str, list[bytes]]) -> PpmModel:
    """Count the trees of each language and tabulate their code lengths."""
    langs = sorted(texts)
    joined = {x: b"".join(texts[x]) for x in langs}
    used = np.zeros(256, bool)
    for x in langs:
        used[np.frombuffer(joined[x], np.uint8)] = True
    classes = np.zeros(256, np.uint8 if used.sum() < 255 else np.uint16)
    classes[used] = np.arange(1, used.sum() + 1)
    a = int(used.sum()) + 1
    trees = []
    for x in langs:
        parts = []
        for t in texts[x]:
            parts += [classes[np.frombuffer(t, np.uint8)].astype(np.int64), np.zeros(ORDER, np.int64)]
        trees.append(_levels(np.concatenate(parts) if parts else np.zeros(0, np.int64), a))
    # rows: every pair of classes, then each three-class context that some language knows
    triples = np.unique(np.concatenate([t[ORDER][0] // a for t in trees])) if trees else np.zeros(0, np.int64)
    row = np.tile(np.arange(a * a, dtype=np.int32), a)
    row[triples] = a * a + np.arange(len(triples), dtype=np.int32)
    pairs = np.arange(a * a, dtype=np.int64)
    contexts = np.concatenate([pairs, triples])
    # class 0 is in no context: with it as last symbol nothing counts, as the one before only the last does
    order_of_pair = np.where(pairs % a == 0, 0, np.where(pairs // a == 0, 1, 2))
    orders = np.concatenate([order_of_pair, np.full(len(triples), ORDER)])
    bits = np.zeros((len(contexts) * a, len(langs)), np.float32)
    for i, tree in enumerate(trees):
        for at in range(0, len(contexts), 4096):
            part = slice(at, at + 4096)
            bits[at * a : (at + len(contexts[part])) * a, i] = _bits(contexts[part], orders[part], tree, a, a - 1).reshape(-1)
    return PpmModel(langs, classes, row, bits)


def _groups(texts: dict[str, list[bytes]], limits: PpmLimits) -> Iterator[list[str]]:
    """Languages in order of name, in groups whose tables keep to the limits."""
    group: list[str] = []
    used, triples = np.zeros(256, bool), np.zeros(0, np.int32)
    for lang in sorted(texts):
        own_used, own = np.zeros(256, bool), []
        for t in texts[lang]:
            b = np.frombuffer(t, np.uint8).astype(np.int32)
            own_used[b] = True
            own.append(np.unique((b[:-2] << 16) + (b[1:-1] << 8) + b[2:]))
        own = np.unique(np.concatenate(own))
        a, rows = int((used | own_used).sum()) + 1, len(np.union1d(triples, own))
        if group and (len(group) >= limits.group_langs or (a * a + rows) * a * (len(group) + 1) * 4 > limits.group_bytes):
            yield group
            group, used, triples = [], np.zeros(256, bool), np.zeros(0, np.int32)
        group.append(lang)
        used |= own_used
        triples = np.union1d(triples, own)
    if group:
        yield group


def train_ppm(docs: DataFrame, limits: PpmLimits = PpmLimits()) -> PpmModels:
    """Learn every language of documents whose crc32(doc_id as text) mod 3 is not 1."""
    spark = docs.sparkSession
    usable = (
        pick(docs, "doc_id", "text", "lang").where("doc_id is not null and lang is not null and text is not null and text <> ''")
        .where(id_fold(F.col("doc_id"), 3) != 1)
    )
    # of a language with many documents only those of small hash are ranked, about twice
    # as many as are taken, so no task meets a whole language
    share = usable.groupBy("lang").agg((F.lit(2.0 * limits.docs_per_lang + 100) / F.count("*")).alias("share"))
    fraction = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = usable.select("doc_id", "lang", F.octet_length("text").alias("size")).join(broadcast_rows(share, 100), "lang").where(fraction < F.col("share"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(fraction, F.xxhash64("doc_id"), "doc_id"))
    chosen = few.withColumn("rank", rank).where(F.col("rank") <= limits.docs_per_lang).select("doc_id", "lang", "size").toPandas()
    models = PpmModels(sorted(chosen["lang"].unique()), [])
    for at in range(0, len(models.langs), limits.langs_per_read):
        some = chosen[chosen["lang"].isin(models.langs[at : at + limits.langs_per_read])]
        texts = _read_texts(usable, some, limits)
        for group in _groups(texts, limits):
            model = fit({x: texts[x] for x in group})
            models.size += model.bits.nbytes + model.row.nbytes
            models.groups.append(([models.langs.index(x) for x in group], spark.sparkContext.broadcast(model)))
    return models


def _read_texts(usable: DataFrame, chosen: pd.DataFrame, limits: PpmLimits) -> dict[str, list[bytes]]:
    """The first bytes of every sampled text by language, as many of each as fit together."""
    most = chosen.groupby("lang")["size"].apply(lambda sizes: _share(np.sort(sizes.to_numpy()), limits.bytes_per_lang))
    small = chosen[["doc_id", "lang"]].drop_duplicates().assign(most=lambda x: x["lang"].map(most))
    found = usable.join(F.broadcast(usable.sparkSession.createDataFrame(small)), ["doc_id", "lang"])
    got = found.select("doc_id", "lang", "most", F.expr("substring(cast(text as binary), 1, cast(most as int))").alias("text")).toArrow().to_pylist()
    texts: dict[str, list[bytes]] = {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["lang"], r["text"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    return texts


def _share(sizes: np.ndarray, most: int) -> int:
    """The largest number of bytes a text, so that texts of these sorted sizes cut there
    have ``most`` bytes together at most; 1 at least."""
    before = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    whole = before + sizes * np.arange(len(sizes), 0, -1) <= most
    if whole.all():
        return int(sizes[-1])
    i = int(whole.argmin())
    return max(1, int((most - before[i]) // (len(sizes) - i)))


def identify_language(docs: DataFrame, model: PpmModels, limits: PpmLimits = PpmLimits()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte for every whole text."""
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1)
        buf, offs = buffers(texts)
        n, size = len(offs) - 1, np.diff(offs)
        has = np.diff(np.concatenate([[0], np.cumsum(ascii_letter[buf])])[offs]) > 0
        for i in np.flatnonzero(~has & (size > 0)):
            has[i] = any(c.isalpha() for c in bytes(buf[offs[i] : offs[i + 1]]).decode("utf-8", "replace"))
        if not model.langs:
            has[:] = False
            best, score, least = np.zeros(n, int), np.zeros(n), np.zeros(n)
        else:
            per_byte = model.code_lengths(buf, offs, limits.kept_bytes) / np.maximum(size, 1)[:, None]
            best = per_byte.argmin(1)
            least = per_byte.min(1)
            score = 1 / np.exp2(-limits.sharpness * (per_byte - least[:, None])).sum(1)
        names = [model.langs[b] if h else "und" for b, h in zip(best, has)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(np.where(has, score, 0.0)), pa.array(np.where(has, least, 0.0))],
            names=["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"],
        )

    source = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(id_fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"))
    return map_pieces(source, run, "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double")
