"""Near duplicates by SimHash fingerprints that meet at the anchors of a covering code.

A text's fingerprint has a bit set where over half of its three-word shingles' XXH64 have
it.  Fingerprints link where they differ in at most three bits, so they differ in at most
one bit in one of the two halves.  Anchors of a half are the words of the Hamming code of
31 bits: its covering radius is 1, so every half has one anchor within 1 ("home").  A
fingerprint goes to every anchor within 2 of its half, the radius plus the threshold there
(16 of them, or itself alone where it is a code word), and is compared, whole, with those
whose home the anchor is: the home of the smaller of two linked fingerprints has both.

Only distinct fingerprints travel.  An anchor that is home to more than ``HOT`` of them is
split: its members go on to the anchors of the other half's quarters (Hamming code of 15
bits), and those of a quarter that is as hot to the other quarter's bytes (7 bits), by the
same argument.  No task emits pairs: what links in a bucket is joined there, and each
fingerprint is sent with the smallest one of its class.

Defined results: a null, empty or blank text has no shingles, fingerprint zero, and links
like any other; texts of one or two words have their whole sequence as one shingle.
Repeated rows are documents of their own, rows with null ids take part, and a class of null
ids alone has none; an empty table gives no rows.  Texts are handled whole, shingles of very
long ones in blocks; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .jaccard_trie import _dealt_join as dealt_join
from .shared_windows import settled_result, work_dir
from .textbatch import LOWER, U64, Words, broadcast_rows, buffers, frugal, frugal_group, map_pieces, pick, spaced

SIZE, SEED = 3, 42
DISTANCE = 3
#: Fingerprints whose home is one anchor, beyond which it is split.
HOT = 4096
#: Check bits of the Hamming codes of the three levels, and bits of the parts they lie in.
CHECKS = (5, 4, 3)
PART = (32, 16, 8)
#: Rows of a bucket, pairs that are compared and shingles that are hashed together.
BUCKET_ROWS = 1 << 18
PAIRS = 1 << 20
SHINGLES = 1 << 16


def fingerprints(texts: pa.Array) -> np.ndarray:
    buf, offs = buffers(texts)
    buf = LOWER[buf]
    words = Words(buf, offs, hashed=False)
    clear, begin = spaced(buf, words)
    n = np.diff(words.first)
    many = np.where(n >= SIZE, n - SIZE + 1, np.minimum(n, 1))
    last = np.cumsum(many)
    view, digest = memoryview(clear), xxhash.xxh64_intdigest
    counts = np.zeros((len(n), 64), np.int64)
    for a in range(0, int(many.sum()), SHINGLES):
        at = np.arange(a, min(a + SHINGLES, int(last[-1])))
        doc = np.searchsorted(last, at, "right")
        word = words.first[doc] + at - (last - many)[doc]
        starts, ends = begin[word].tolist(), (begin[word + np.minimum(n[doc], SIZE)] - 1).tolist()
        h = np.fromiter((digest(view[i:j], SEED) for i, j in zip(starts, ends)), "<u8", len(at))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        head = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        counts[doc[head]] += np.add.reduceat(bits, head, axis=0, dtype=np.int64)
    return np.packbits(2 * counts > many[:, None], axis=1, bitorder="little").view("<u8").ravel()


def syndrome(v: np.ndarray, checks: int) -> np.ndarray:
    """Exclusive or of the places (from 1) of the bits that are set."""
    places = np.arange(1, 1 << checks)
    out = np.zeros(len(v), np.int64)
    for c in range(checks):
        mask = int((1 << (places[(places >> c) & 1 == 1] - 1)).sum())
        out |= (np.bitwise_count(v & mask) & 1).astype(np.int64) << c
    return out


def anchors(v: np.ndarray, checks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``v`` and code words of the Hamming code within 2 of each, and whether the
    code word is its home."""
    s = syndrome(v, checks)
    home = v ^ np.where(s > 0, np.int64(1) << np.maximum(s - 1, 0), 0)
    # two bits bring v to a code word if their places' exclusive or is its syndrome
    odd = np.flatnonzero(s)
    i = np.arange(1, 1 << checks)
    j = i ^ s[odd][:, None]
    row, col = np.nonzero(j > i)
    far = v[odd[row]] ^ (np.int64(1) << (i[col] - 1)) ^ (np.int64(1) << (j[row, col] - 1))
    near = np.arange(len(v))
    return np.append(near, odd[row]), np.append(home, far), np.append(np.ones(len(v), bool), np.zeros(len(row), bool))


def keys_of(key: np.ndarray, value: np.ndarray, home: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, key, home) of the keys of a level, below the keys of the level before: of the
    ``2 * PART[level]`` bits of ``value``, both halves go to their anchors."""
    width, places, keys, homes = PART[level], [], [], []
    for half in (0, 1):
        part = (value >> (width * half)) & ((1 << (width - 1)) - 1)
        at, code, own = anchors(part, CHECKS[level])
        places.append(at)
        keys.append((key[at] << width) | (half << (width - 1)) | code)
        homes.append(own & home[at])
    return np.concatenate(places), np.concatenate(keys), np.concatenate(homes)


def _send(fps: DataFrame, homes_only: bool = False) -> DataFrame:
    """(level, key, fp, value, home): each fingerprint at its anchors of the first level;
    ``value`` holds the bits of the other half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            at, key, home = keys_of(np.zeros(len(fp), np.int64), fp, np.ones(len(fp), bool), 0)
            if homes_only:
                at, key, home = at[home], key[home], home[home]
            other = (fp[at] >> (32 * (1 - (key >> 31)))) & 0xFFFFFFFF
            yield _rows(0, key, fp[at], other, home)

    return fps.select("fp").mapInArrow(frugal(run), _SENT)


_SENT = "level int, key long, fp long, value long, home boolean"


def _rows(level: int, key: np.ndarray, fp: np.ndarray, value: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), level, np.int32)), pa.array(key), pa.array(fp), pa.array(value), pa.array(home)], names=["level", "key", "fp", "value", "home"])


def _split(sent: DataFrame, level: int) -> DataFrame:
    """The rows of hot keys at the anchors of the next level."""
    width = PART[level]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, fp, value, home = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(1, 5))
            at, keys, homes = keys_of(key, value, home, level)
            half = (keys >> (width - 1)) & 1
            other = (value[at] >> (width * (1 - half))) & ((1 << width) - 1)
            yield _rows(level, keys, fp[at], other, homes)

    return sent.mapInArrow(frugal(run), _SENT)


def join_classes(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the smallest member of each class) after linking a[i] with b[i]."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _compare(table: pa.Table) -> pa.Table:
    """Links of a bucket: every fingerprint with the smallest one of its class here."""
    level, key, fp = (table.column(c).to_numpy() for c in ("level", "key", "fp"))
    home = table.column("home").to_numpy()
    order = np.lexsort((key, level))
    level, key, fp, home = level[order], key[order], fp[order], home[order]
    head = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (level[1:] != level[:-1])))
    size = np.diff(np.append(head, len(key)))
    group = np.repeat(np.arange(len(head)), size)
    own = np.flatnonzero(home & (size[group] > 1))
    known, number = np.unique(fp, return_inverse=True)
    label = np.arange(len(known))
    first, many = head[group[own]], size[group[own]]
    step = np.cumsum(many) // PAIRS
    for cut in np.split(np.arange(len(own)), np.flatnonzero(np.diff(step)) + 1):
        if len(cut):
            i = np.repeat(own[cut], many[cut])
            j = np.arange(len(i)) + np.repeat(first[cut] - np.cumsum(many[cut]) + many[cut], many[cut])
            near = (fp[i] < fp[j]) & (np.bitwise_count((fp[i] ^ fp[j]).view(U64)) <= DISTANCE)
            label = join_classes(label, number[i[near]], number[j[near]])
    linked = np.flatnonzero(label != np.arange(len(label)))
    return pa.table({"u": known[linked], "v": known[label[linked]]})


def _links(fps: DataFrame, hot: int) -> DataFrame:
    """Links (u, v) that join all fingerprints within ``DISTANCE`` of each other."""
    parts, sent, homes = [], _send(fps), _send(fps, True)
    for level in range(len(PART)):
        if level + 1 == len(PART):
            parts.append(sent)
            break
        crowded = homes.where("home").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key")
        if not crowded.limit(1).count():
            parts.append(sent)
            break
        crowded = broadcast_rows(crowded, 16)
        parts.append(sent.join(crowded, "key", "left_anti"))
        sent = homes = _split(sent.join(crowded, "key", "left_semi").select("level", "key", "fp", "value", "home"), level + 1)
    out = parts[0].select("level", "key", "fp", "home")
    for part in parts[1:]:
        out = out.union(part.select("level", "key", "fp", "home"))
    buckets = 1 + 34 * fps.count() // BUCKET_ROWS
    placed = out.withColumn("bucket", F.pmod(F.xxhash64("level", "key"), F.lit(buckets)))
    return placed.groupBy("bucket").applyInArrow(frugal_group(_compare), "u long, v long")


def simhash_classes(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, fp, component_id) of every document; ``fp`` is the fingerprint's 64 bits as a
    long, component_id the smallest doc_id that links reach.  The rows are written to the
    shared folder (``release`` deletes them), all else that was written there is deleted."""
    spark = docs.sparkSession
    root = work_dir(spark)
    source = pick(docs, "doc_id", "text").selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")

    def measure(piece: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([piece.column(0), pa.array(fingerprints(piece.column(1)).view(np.int64))], names=["doc_id", "fp"])

    map_pieces(source, measure, "doc_id long, fp long").write.parquet(f"{root}/prints")
    prints = spark.read.parquet(f"{root}/prints")
    prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).write.parquet(f"{root}/distinct")
    distinct = spark.read.parquet(f"{root}/distinct")
    _links(distinct.select("fp"), hot).distinct().write.parquet(f"{root}/links")
    near, _ = connected_components(spark.read.parquet(f"{root}/links"), f"{root}/near")
    member = near.union(near.select(F.col("root").alias("node"), "root").distinct())
    of = distinct.join(member, F.col("fp") == F.col("node"), "left").select("fp", "first", "n", "root")
    of.write.parquet(f"{root}/classes")
    of = spark.read.parquet(f"{root}/classes")
    least = of.where("root is not null").groupBy("root").agg(F.min("first").alias("least"))
    linked = dealt_join(of.where("root is not null").withColumn("key", F.col("fp")), least, ["root"]).select("fp", "first", "n", "least")
    named = linked.union(of.where("root is null").select("fp", "first", "n", F.col("first").alias("least")))
    named.write.parquet(f"{root}/named")
    named = spark.read.parquet(f"{root}/named")
    # a fingerprint of one document is that document's row; only the others meet their documents
    alone = named.where("n = 1").select(F.col("first").alias("doc_id"), "fp", F.col("least").alias("component_id"))
    shared = named.where("n > 1").select("fp", "least")
    several = dealt_join(prints.withColumn("key", F.col("doc_id")), shared, ["fp"]).select("doc_id", "fp", F.col("least").alias("component_id"))
    return settled_result(alone.union(several), root, "prints", "distinct", "links", "near", "classes", "named")


def simhash_digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id."""
    return simhash_classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
