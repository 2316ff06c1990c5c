"""Vectorised text kernels over Arrow batches, shared by the text operators.

Texts arrive as Arrow string batches and are handled as one byte buffer with
document offsets.  Batches are cut into pieces of about ``PIECE_BYTES`` so that
temporary arrays stay small; one text is never cut, however long it is.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE_BYTES = 2 << 20
BATCH_BYTES = 8 << 20
U64 = np.uint64
MOST_BROADCAST = 64 << 20
try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library: nothing to trim
    _LIBC = None
#: Ranges up to this long are hashed in numpy, longer ones by a keyed digest each.
LONG = 256

#: Bytes of a word of ``[^\x20\x09-\x0D]+``.
SPACE_WORD = np.ones(256, bool)
SPACE_WORD[[0x20, 9, 10, 11, 12, 13]] = False
#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly the named columns, found by exact spelling; a column that clashes
    by case or a column named like an intermediate result is left out."""
    columns = df.columns
    at = [columns.index(n) for n in names]
    flat = df.toDF(*[f"_c{i}" for i in range(len(columns))])
    return flat.select(*[F.col(f"_c{i}").alias(n) for i, n in zip(at, names)])


def positional(df: DataFrame) -> tuple[DataFrame, dict]:
    """The table with its columns renamed by place, and the new name of each old one, by
    its place and by its exact spelling: nothing inside can clash with a user's column."""
    names = [f"_c{i}" for i in range(len(df.columns))]
    place: dict = dict(enumerate(names))
    for name, own in zip(df.columns, names):
        place.setdefault(name, own)
    return df.toDF(*names), place


def text_key(text: Column) -> Column:
    """16 bytes that texts share exactly if they are equal (MD5; a null text is empty)."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def broadcast_rows(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcast if its counted rows, of some ``row_bytes`` each, have at
    most ``MOST_BROADCAST`` bytes; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= MOST_BROADCAST else df


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    h = h ^ (h >> U64(31))
    h = h * U64(0x7FB5D329728EA185)
    h ^= h >> U64(27)
    h *= U64(0x81DADEF4BC2DD44D)
    h ^= h >> U64(33)
    return h


def wide_bytes(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros past the end."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))


def _chunk(wide: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    value = wide[at].astype(U64)
    short = left < 8
    value[short] &= (U64(1) << (U64(8) * left[short].astype(U64))) - U64(1)
    return value


def range_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; equal bytes give equal hashes wherever they lie.

    Eight bytes at a time go through a bijective mixer, so no sums of powers can cancel;
    ranges over ``LONG`` bytes take a keyed BLAKE2b digest.  A hash only finds candidates:
    what is counted, removed or linked compares the bytes (``exact_ids``)."""
    left = (ends - starts).astype(np.int64)
    h = mix(left.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(0x2545F4914F6CDD1D))
    long = left > LONG
    if long.any():
        view = memoryview(np.ascontiguousarray(buf))
        for i in np.flatnonzero(long).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(view[int(starts[i]) : int(ends[i])], digest_size=8, key=b"ranges").digest(), "little")
    wide, live = wide_bytes(buf), np.flatnonzero((left > 0) & ~long)
    at, rest = starts[live].astype(np.int64), left[live]
    while len(live):
        h[live] = mix((h[live] ^ _chunk(wide, at, rest)) + U64(0x632BE59BD9B4E019))
        more = rest > 8
        live, at, rest = live[more], at[more] + 8, rest[more] - 8
    return h


def same_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ranges of ``size`` bytes from a and from b hold the same bytes."""
    same = np.ones(len(a), bool)
    long = size > LONG
    if long.any():
        view = memoryview(np.ascontiguousarray(buf))
        for i in np.flatnonzero(long).tolist():
            same[i] = view[int(a[i]) : int(a[i] + size[i])] == view[int(b[i]) : int(b[i] + size[i])]
    wide, live = wide_bytes(buf), np.flatnonzero((size > 0) & ~long)
    a, b, rest = a[live].astype(np.int64), b[live].astype(np.int64), size[live].astype(np.int64)
    while len(live):
        equal = _chunk(wide, a, rest) == _chunk(wide, b, rest)
        same[live[~equal]] = False
        more = equal & (rest > 8)
        live, a, b, rest = live[more], a[more] + 8, b[more] + 8, rest[more] - 8
    return same


def exact_ids(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
    """A number for each byte range, the same for two ranges exactly if their bytes are:
    hashes bring equal ranges together, and their bytes are compared."""
    h = range_hashes(buf, starts, ends) if hashes is None else hashes
    order = np.argsort(h, kind="stable")
    starts, size = starts[order], (ends - starts)[order]
    new = np.ones(len(order), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    tied = np.flatnonzero(~new)
    equal = size[tied] == size[tied - 1]
    equal[equal] = same_bytes(buf, starts[tied[equal]], starts[tied[equal] - 1], size[tied[equal]])
    ids = np.cumsum(new) - 1
    if not equal.all():  # different bytes under one hash: number these groups by their bytes
        known: dict[tuple[int, bytes], int] = {}
        following = int(ids[-1]) + 1
        for i in np.flatnonzero(np.isin(ids, ids[tied[~equal]])).tolist():
            key = (int(ids[i]), bytes(buf[starts[i] : starts[i] + size[i]]))
            if key not in known:
                known[key], following = following, following + 1
            ids[i] = known[key]
    out = np.empty(len(order), np.int64)
    out[order] = ids
    return out


class Words:
    """Word starts, ends (bytes), document index and 64-bit hash for one piece."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, lut: np.ndarray = SPACE_WORD, hashed: bool = True):
        inside = lut[buf]
        before = np.zeros(len(buf), bool)
        before[1:] = inside[:-1]
        first = offs[:-1][offs[:-1] < offs[1:]]
        before[first] = False
        after = np.zeros(len(buf), bool)
        after[:-1] = inside[1:]
        after[offs[1:][offs[:-1] < offs[1:]] - 1] = False
        self.inside = inside
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        #: Index of each document's first word, and one past the last document's.
        self.first = np.searchsorted(self.start, offs)
        self.doc = np.repeat(np.arange(len(offs) - 1), np.diff(self.first))
        self.hash = range_hashes(buf, self.start, self.end) if hashed else None


def flagged(begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Flags of ``n`` tokens, true inside the disjoint spans."""
    edges = np.zeros(n + 1, np.int8)
    edges[begin] += 1
    edges[end] -= 1
    return np.cumsum(edges[:n], dtype=np.int8).view(bool)


def spaced(buf: np.ndarray, words: Words, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The words (those of ``keep``) with one space after each, and where each begins there."""
    start, end = (words.start, words.end) if keep is None else (words.start[keep], words.end[keep])
    size = end - start
    begin = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size + 1, out=begin[1:])
    inside = words.inside
    if keep is not None:
        inside = inside & flagged(start, end, len(buf))
    out = np.full(int(begin[-1]), 32, np.uint8)
    taken = np.ones(len(out), bool)
    taken[begin[1:] - 1] = False
    out[taken] = buf[inside]
    return out, begin


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and int64 offsets of a string array; null counts as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "" if not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and len(offs) else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def pieces(batch: pa.RecordBatch, text: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each."""
    if not batch.num_rows:
        return
    _, offs = buffers(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches have some MB at most, so that a few thousand long texts don't
    meet in one; a smaller limit of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    limit = spark.conf.get(key).rstrip("b")
    if not limit.isdigit() or int(limit) <= 0 or int(limit) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def release_memory() -> None:
    """Give freed memory back to the system: Python workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with memory released when a task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


def frugal_group(solve: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``solve`` for applyInArrow, with memory released after a large group."""

    def wrapped(table: pa.Table) -> pa.Table:
        out = solve(table)
        if table.nbytes > 1 << 20:
            release_memory()
        return out

    return wrapped


def map_pieces(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: str = "text", most: int = PIECE_BYTES) -> DataFrame:
    """``fn`` over every piece of every partition; a partition-local, shuffle-free step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text, most):
                out = fn(piece)
                if out is not None:
                    yield out

    small_batches(df.sparkSession)
    return df.mapInArrow(frugal(run), schema)


def per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive ``bounds`` (empty ranges give 0)."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32(doc_id as text) mod ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``), qualified by
    Hadoop.  Where it is unset, a local session, as in tests, gets a folder of its own; on
    a cluster that is an error, as no machine's own folder would do."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(root)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
