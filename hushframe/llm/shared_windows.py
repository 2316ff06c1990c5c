"""Windows of tokens that occur more than once in a corpus, without moving its texts.

Texts are cut into blocks (a written table in the shared folder) and stay there.
Every window of ``window`` tokens has an anchor hash, the smallest hash of ``gram``
tokens in it, so equal windows have equal anchors wherever they lie:

1. each block sends its distinct anchor hashes, packed by hash range ("bucket");
2. a bucket finds the anchors that occur twice or more and answers each block;
3. a block cuts runs of windows around shared anchors as segments and sends them with
   their bytes;
4. a bucket solves the segments of an anchor by the operator's solver (a suffix array or
   suffix trees), which alone decides which of their windows are repeats;
5. blocks are read again with the runs of repeated windows that came back.

Of segments with the same bytes, compared byte by byte, the first two by the operator's
key are sent and solved: the others' windows are theirs, so they share the second's fate.
Hashes only choose what meets, as equal bytes have equal hashes.  A block's answers lie together, so steps 3 to 5 read
them beside the text.  An anchor with more than ``hot`` different surroundings sends no
segments; of its windows, those whose own hash occurs twice travel by that hash instead
(two more small exchanges, of hashes), so no task gathers an unbounded group.
"""

from __future__ import annotations

import gc
import math
import threading
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .textbatch import buffers, frugal, frugal_group, mix, pieces, range_hashes, same_bytes, shared_dir, small_batches, U64

#: Of a hash 37 bits and the bucket's are kept; the other three bits of a packed entry count.
#: Two hashes that fall together only look shared; what follows compares exactly.
KEPT = 37
LOW = U64((1 << KEPT) - 1)
PACKED = 5
COUNT = U64(7)
BLOCK_BYTES = 16 << 20
ROWS = 1 << 21
BUCKET_BYTES = 6 << 20
#: Blocks and buckets grow with the root of the corpus, so that a row from a block to a
#: bucket carries some tens of bytes or more at any size.
ROOT_SCALE = 256
#: Bytes that are solved together, bytes of text that are cut into windows together, and
#: windows of the longest segment.
TOGETHER = 1 << 17
WINDOW_BYTES = 1 << 20
MOST_WINDOWS = 1024
#: Partitions whose answers lie in a folder of their own each; of more, so many share one.
PARTS, SHARE = 1024, 16
#: Blocks that a partition may have: its number's lower bits.
BLOCK_BITS = 12
#: File systems that both Hadoop and Arrow open by the same address.
SCHEMES = ("file", "hdfs", "viewfs", "gs", "abfs", "abfss", "s3")
_MULT = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []
_mine = threading.local()


@dataclass(frozen=True)
class Windows:
    """``key_by_doc``: a window is a repeat if a smaller doc_id has it (op on bytes), else
    if it starts earlier by (doc_id, start).  ``hot``: different surroundings of an anchor
    from which its windows travel by their own hash."""

    window: int
    gram: int
    key_by_doc: bool
    hot: int = 1 << 15


class Tokens:
    """Tokens of a piece: token i lies in ``data`` from ``begin[i]`` to ``begin[i + 1]``
    (byte i where ``begin`` is None); ``first``: each document's first token."""

    def __init__(self, values: Callable[[int, int], np.ndarray], data: np.ndarray, begin: np.ndarray | None, first: np.ndarray):
        self.values, self.data, self.begin, self.first = values, data, begin, first

    def bytes_of(self, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the bytes of ``count`` tokens from ``start`` on."""
        return (start, start + count) if self.begin is None else (self.begin[start], self.begin[start + count])


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers.clear()
        for m in (_MULT, pow(_MULT, -1, 1 << 64)):
            p = np.full(n, m, U64)
            p[0] = 1
            _powers.append(np.cumprod(p))
    return _powers


class Runs:
    """Maximal runs of windows with one anchor hash, of at most ``MOST_WINDOWS``: start
    (token), number of windows, anchor hash, document, a hash of the run's tokens, and
    whether the run holds its anchor more than once.
    Tokens are taken in chunks, so a very long text needs no more memory than a chunk."""

    def __init__(self, tokens: Tokens, spec: Windows, chunk: int = WINDOW_BYTES):
        n, found = int(tokens.first[-1]), []
        for a in range(0, max(n - spec.window + 1, 0), chunk):
            part = self._chunk(tokens, spec, a, min(a + chunk, n - spec.window + 1))
            if part is not None:
                found.append(part)
        columns = zip(*found) if found else [np.zeros(0, np.int64)] * 2 + [np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, bool)]
        self.start, self.count, self.hash, self.doc, self.content, self.again = [np.concatenate(c) if found else c for c in columns]

    @staticmethod
    def _chunk(tokens: Tokens, spec: Windows, a: int, b: int):
        """Runs of the windows that start in [a, b)."""
        first, k, w = tokens.first, spec.gram, spec.window - spec.gram + 1
        d0 = int(np.searchsorted(first, a, "right")) - 1
        d1 = int(np.searchsorted(first, b, "left"))
        low = np.maximum(first[d0:d1], a)
        count = np.maximum(np.minimum(first[d0 + 1 : d1 + 1] - spec.window + 1, b) - low, 0)
        total = int(count.sum())
        if not total:
            return None
        values = tokens.values(a, b + spec.window - 1)
        n = len(values)
        up, down = _power_tables(n + 1)
        prefix = np.zeros(n + 1, U64)
        np.cumsum(values * up[:n], out=prefix[1:])
        grams = mix((prefix[k:] - prefix[:-k]) * down[: n - k + 1])
        key = (grams & U64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=U64)  # leftmost of equal ones
        span = 1
        while span * 2 <= w:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span < w:
            key = np.minimum(key[: len(key) - (w - span)], key[w - span :])
        doc = np.repeat(np.arange(d0, d1), count)
        at = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low - a, count)
        anchor = (key[at] & U64(0xFFFFFFFF)).astype(np.int64)
        least = grams[anchor]
        new = np.ones(total, bool)
        new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, total))
        if int(size.max()) > MOST_WINDOWS:  # periodic text: one anchor hash over many windows
            cuts = -(-size // MOST_WINDOWS)
            head = np.repeat(head, cuts) + MOST_WINDOWS * (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts))
            size = np.diff(np.append(head, total))
        start, length = at[head], size + spec.window - 1
        content = mix((prefix[start + length] - prefix[start]) * down[start] + length.astype(U64))
        # equal windows of one run have their anchors at different places
        again = anchor[head] != anchor[head + size - 1]
        # the least of many hashes is small: mixed again, so that buckets fill evenly
        return start + a, size, mix(least[head] + U64(1)), doc[head], content, again


def _open_folders() -> list[str]:
    """Folders made in this thread: what runs beside it in the driver has its own."""
    if not hasattr(_mine, "folders"):
        _mine.folders = []
    return _mine.folders


def work_dir(spark: SparkSession) -> str:
    """A new folder below the shared one; ``release`` deletes it, if its user doesn't."""
    root = shared_dir(spark)
    scheme = root.split(":", 1)[0]
    if scheme not in SCHEMES:
        raise ValueError(f"spark.checkpoint.dir has the scheme {scheme}, which Python on executors can't open")
    _open_folders().append(f"{root}/windows-{uuid.uuid4().hex}")
    return _open_folders()[-1]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession, but: str | None = None) -> None:
    """Delete every folder that operators called in this thread still hold, those made
    before ``but`` and itself excepted: call it when results were written or are not needed."""
    held = _open_folders()
    kept = held.index(but) + 1 if but in held else 0
    for path in held[kept:]:
        remove(spark, path)
        held.remove(path)


def settled_result(result: DataFrame, root: str, *folders: str) -> DataFrame:
    """Write a result below ``root`` and delete the folders that it was made from."""
    spark = result.sparkSession
    result.write.parquet(f"{root}/result")
    for f in folders:
        remove(spark, f"{root}/{f}")
    return spark.read.parquet(f"{root}/result")


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a qualified folder, as executors' Python reaches it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        raise ValueError(f"{path} is not a qualified address")
    return pafs.FileSystem.from_uri(path)


def block_size(docs: DataFrame) -> int:
    """Bytes of a block: ``BLOCK_BYTES`` to some TB, then the root of the corpus' size, as
    far as the optimiser knows it (an unknown size is told by its absurd default)."""
    known = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(BLOCK_BYTES, math.isqrt(ROOT_SCALE * 4 * known)) if known < 1 << 58 else BLOCK_BYTES


def write_blocks(docs: DataFrame, path: str, block_bytes: int, whole: bool = False) -> DataFrame:
    """(block, row, doc_id, text, n_bytes): a map-only copy of the scan, in which a block is
    a run of rows of one partition and a row is numbered in its block.  With ``whole`` the
    other columns follow as x0, x1, ... in their order."""
    spark = docs.sparkSession
    small_batches(spark)
    others = [i for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")] if whole else []
    flat = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    at = docs.columns.index
    source = flat.select(F.col(f"_c{at('doc_id')}").cast("long").alias("doc_id"), F.col(f"_c{at('text')}").cast("string").alias("text"), *[F.col(f"_c{i}").alias(f"x{n}") for n, i in enumerate(others)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << BLOCK_BITS
        block, row, held = first, 0, 0
        for batch in batches:
            for piece in pieces(batch):
                _, offs = buffers(piece.column(1))
                n = piece.num_rows
                if row and (held + int(offs[-1]) > block_bytes or row + n > ROWS):
                    block, row, held = block + 1, 0, 0
                    if block - first >> BLOCK_BITS:
                        raise ValueError(f"a partition has more than {1 << BLOCK_BITS} blocks of {block_bytes} bytes: repartition the documents")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, block)), pa.array(np.arange(row, row + n)), *piece.columns[:2], pa.array(np.diff(offs)), *piece.columns[2:]],
                    names=["block", "row", "doc_id", "text", "n_bytes", *piece.schema.names[2:]],
                )
                row, held = row + n, held + int(offs[-1])

    schema = StructType([StructField(n, LongType()) for n in ("block", "row", "doc_id")] + [StructField("text", StringType()), StructField("n_bytes", LongType())] + source.schema.fields[2:])
    # texts lie here until the last step: the denser codec, whatever the session's is
    source.mapInArrow(frugal(run), schema).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def by_block(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[int, pa.RecordBatch]]:
    """Pieces of one block each; a block's pieces follow one another."""
    for batch in batches:
        blocks = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                for piece in pieces(batch.slice(a, b - a), text, WINDOW_BYTES):
                    yield int(blocks[a]), piece


def settle(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps, which else stay on the executors'
    disks until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bits_for(total_bytes: int) -> int:
    """Bits of the bucket number, from the corpus' bytes."""
    bucket = max(BUCKET_BYTES, math.isqrt(ROOT_SCALE * total_bytes))
    return max(3, math.ceil(math.log2(max(1, total_bytes / bucket))))


def pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :PACKED]).tobytes()


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, PACKED)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :PACKED] = raw
    return wide.view("<u8").reshape(-1).astype(U64)


def hash_rows(block: int, hashes: np.ndarray, codes: np.ndarray, bits: int) -> pa.RecordBatch:
    """One row a bucket: distinct hashes, ascending, each with a code of three bits."""
    bucket = (hashes >> U64(64 - bits)).astype(np.int64)
    packed = ((hashes & LOW) << U64(3)) | codes.astype(U64)
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(bucket))
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[cuts]), pa.array(np.full(len(cuts), block)), pa.array([pack(packed[a:b]) for a, b in zip(cuts, ends)], pa.binary())],
        names=["bucket", "block", "payload"],
    )


def counted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, and the rounded-down logarithm of their number here (7: or more)."""
    hashes, many = np.unique(hashes, return_counts=True)
    return hashes, np.minimum(np.log2(many).astype(np.int64), 7)


def surroundings(hashes: np.ndarray, contents: np.ndarray, again: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchors, and 0 for a single occurrence, else 1 and the rounded-down
    logarithm of the number of different contents here (7: 64 or more)."""
    order = np.lexsort((contents, hashes))
    h, c = hashes[order], contents[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    differ = new.copy()
    differ[1:] |= c[1:] != c[:-1]
    head = np.flatnonzero(new)
    many = np.add.reduceat(1 + again[order].astype(np.int64), head) if len(head) else head
    kinds = np.add.reduceat(differ.astype(np.int64), head) if len(head) else head
    return h[head], np.where(many > 1, 1 + np.minimum(np.log2(np.maximum(kinds, 1)).astype(np.int64), 6), 0)


def frequency_class(codes: np.ndarray, head: np.ndarray) -> np.ndarray:
    """0 for 2 or 3 occurrences, then one more each time they double, up to 7."""
    times = np.add.reduceat(np.int64(1) << codes, head)
    return np.minimum(np.log2(np.maximum(times, 2)).astype(np.int64) - 1, 7)


def shared_hashes(sent: DataFrame, classes: Callable[[np.ndarray, np.ndarray], np.ndarray] = frequency_class) -> DataFrame:
    """(block, bucket, top, payload): for each block those of its hashes that occur twice or
    more, each with ``classes`` (0 to 7) of its codes in all blocks; ``top``: the bucket's largest."""

    def solve(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        blocks = table.column("block").to_numpy()
        data = table.column("payload").to_pylist()
        size = np.array([len(d) // PACKED for d in data])
        entry = unpack(b"".join(data))
        owner = np.repeat(np.arange(len(data), dtype=np.int32), size)
        order = np.argsort(entry)  # by hash, then code
        entry, owner = entry[order], owner[order]
        v, code = entry >> U64(3), (entry & COUNT).astype(np.int64)
        new = np.ones(len(v), bool)
        new[1:] = v[1:] != v[:-1]
        head = np.flatnonzero(new)
        among = np.diff(np.append(head, len(v)))
        good = np.repeat((among > 1) | (code[head + among - 1] > 0), among)
        kind = np.repeat(classes(code, head).astype(U64), among)[good]
        top = int(kind.max()) if len(kind) else 0
        owner, v = owner[good], v[good]
        by = np.argsort(owner, kind="stable")
        owner, out = owner[by], ((v << U64(3)) | kind)[by]
        cuts = np.searchsorted(owner, np.arange(len(data) + 1))
        full = np.flatnonzero(np.diff(cuts))
        return pa.table({"block": blocks[full], "bucket": np.full(len(full), bucket), "top": np.full(len(full), top), "payload": pa.array([pack(out[cuts[i] : cuts[i + 1]]) for i in full], pa.binary())})

    return sent.groupBy("bucket").applyInArrow(frugal_group(solve), "block long, bucket long, top long, payload binary")


def partitions_of(blocks: DataFrame) -> int:
    """Partitions of a table of blocks, by their numbers."""
    last = blocks.agg(F.max("block")).first()[0]
    return 1 if last is None else (last >> BLOCK_BITS) + 1


def write_answers(answers: DataFrame, path: str, partitions: int) -> None:
    """Rows by block, in folders and sorted, so that a task finds its block's rows without a
    join of texts.  Every one of ``PARTS`` partitions has a folder; of more ``SHARE`` share
    one, so that a folder stays small however large the corpus is."""
    folders = max(min(partitions, PARTS), -(-partitions // SHARE))
    placed = answers.withColumn("folder", F.pmod(F.shiftright("block", BLOCK_BITS), F.lit(folders)).cast("int"))
    placed.repartition("folder").sortWithinPartitions("folder", "block").write.option("parquet.block.size", 4 << 20).partitionBy("folder").parquet(f"{path}/of-{folders}")


def read_answers(path: str, block: int, columns: list[str]) -> list[dict]:
    """The rows of a block; an error where the table itself can't be seen from here."""
    fs, root = filesystem(path)
    tables = [f for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.base_name.startswith("of-")]
    if len(tables) != 1:
        raise FileNotFoundError(f"{path} was written, but this executor's Python doesn't see it")
    folder = (block >> BLOCK_BITS) % int(tables[0].base_name[3:])
    found = fs.get_file_info(pafs.FileSelector(f"{root}/{tables[0].base_name}/folder={folder}", allow_not_found=True))
    rows: list[dict] = []
    for f in found:
        if f.is_file and f.path.endswith(".parquet"):
            with fs.open_input_file(f.path) as src:
                file = pq.ParquetFile(src)
                at = file.schema_arrow.names.index("block")
                for g in range(file.num_row_groups):
                    stats = file.metadata.row_group(g).column(at).statistics
                    if stats is not None and stats.has_min_max and not stats.min <= block <= stats.max:
                        continue
                    table = file.read_row_group(g, columns=["block", *columns])
                    rows += table.filter(pa.array(table.column("block").to_numpy() == block)).select(columns).to_pylist()
    return rows


class Shared:
    """A block's shared hashes with their classes, for look-up."""

    def __init__(self, path: str, block: int, bits: int):
        self.bits = bits
        rows = read_answers(path, block, ["bucket", "payload"])
        entries = [unpack(r["payload"]) for r in rows]
        keys = [(U64(r["bucket"]) << U64(KEPT)) | (e >> U64(3)) for r, e in zip(rows, entries)]
        self.keys = np.concatenate(keys) if keys else np.zeros(0, U64)
        kinds = np.concatenate([(e & COUNT).astype(np.int8) for e in entries]) if entries else np.zeros(0, np.int8)
        order = np.argsort(self.keys)
        self.keys, self.kinds = self.keys[order], kinds[order]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Class of each hash, -1 where it isn't shared."""
        if not len(self.keys):
            return np.full(len(hashes), -1, np.int8)
        key = ((hashes >> U64(64 - self.bits)) << U64(KEPT)) | (hashes & LOW)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.kinds[at], -1)


#: One segment: hash of its anchor, place, windows and bytes.
ENTRY = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("row", "<i4"), ("start", "<i4"), ("count", "<i4"), ("size", "<i4")])
RUN = np.dtype([("row", "<i4"), ("start", "<i4"), ("count", "<i4")])
#: A segment (row, start, count) that has the fate of the one at (of_row, of_start).
FOLLOWER = np.dtype([("row", "<i4"), ("start", "<i4"), ("count", "<i4"), ("of_row", "<i4"), ("of_start", "<i4")])
Tokenise = Callable[[np.ndarray, np.ndarray], Tokens]


def _hot_windows(tokens: Tokens, runs: Runs, hot: np.ndarray, spec: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, document and own hash of every window of the runs ``hot``."""
    many = runs.count[hot]
    at = np.repeat(runs.start[hot], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return at, np.repeat(runs.doc[hot], many), range_hashes(tokens.data, *tokens.bytes_of(at, np.full(len(at), spec.window)))


def _joined(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> bytes:
    view = memoryview(np.ascontiguousarray(data))
    return b"".join([view[a:b] for a, b in zip(start.tolist(), stop.tolist())])


def _piece_entries(piece: pa.RecordBatch, tokens: Tokens, runs: Runs, kind: np.ndarray, shared: Shared | None, spec: Windows) -> tuple[np.ndarray, bytes]:
    """The segments of a piece around shared anchors, and their bytes one after another."""
    cold, hot = np.flatnonzero(kind == 0), np.flatnonzero(kind > 0)
    start, count, h, doc = runs.start[cold], runs.count[cold], runs.hash[cold], runs.doc[cold]
    if len(hot) and shared is not None:  # every shared window by its own hash
        at, of, own = _hot_windows(tokens, runs, hot, spec)
        live = shared.find(own) >= 0
        start, count = np.concatenate([start, at[live]]), np.concatenate([count, np.ones(int(live.sum()), np.int64)])
        h, doc = np.concatenate([h, own[live]]), np.concatenate([doc, of[live]])
    ids = piece.column(2)
    known = ~np.asarray(ids.is_null())[doc]
    start, count, h, doc = start[known], count[known], h[known], doc[known]
    begin, end = tokens.bytes_of(start, count + spec.window - 1)
    e = np.zeros(len(start), ENTRY)
    e["hash"], e["doc"], e["row"], e["count"] = h, ids.fill_null(0).to_numpy()[doc], piece.column(1).to_numpy()[doc], count
    e["size"] = end - begin
    e["start"] = start - tokens.first[doc]
    return e, _joined(tokens.data, begin, end)


def _cuts(values: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    if not len(values):
        return []
    at = np.flatnonzero(np.append(True, values[1:] != values[:-1])).tolist()
    return list(zip(at, [*at[1:], len(values)]))


def _alike(entries: np.ndarray, data: np.ndarray, begin: np.ndarray, spec: Windows) -> tuple[np.ndarray, np.ndarray]:
    """An order by anchor and bytes, and in it the place of the segment whose fate each
    shares.  Segments of one anchor and the same bytes have the same windows, so those
    with the first one's key share its fate, and all later ones that of the second."""
    size = entries["size"].astype(np.int64)
    content = range_hashes(data, begin, begin + size)
    order = np.lexsort((entries["row"], entries["start"], entries["doc"], content, entries["hash"]))
    entries, begin, size, content = entries[order], begin[order], size[order], content[order]
    new = np.ones(len(entries), bool)
    new[1:] = (content[1:] != content[:-1]) | (entries["hash"][1:] != entries["hash"][:-1])
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)[group]
    tied = np.flatnonzero(~new)
    equal = size[tied] == size[first[tied]]
    equal[equal] = same_bytes(data, begin[tied[equal]], begin[first[tied[equal]]], size[tied[equal]])
    tied = tied[equal]
    of, own = entries[first[tied]], entries[tied]
    later = own["doc"] > of["doc"]
    same = own["doc"] == of["doc"]
    if not spec.key_by_doc:
        later |= same & (own["start"] > of["start"])
        same &= own["start"] == of["start"]
    fate = np.arange(len(entries))
    fate[tied[same]] = first[tied[same]]
    groups, at = np.unique(group[tied[later]], return_index=True)
    second = np.zeros(int(group[-1]) + 1 if len(group) else 0, np.int64)
    second[groups] = tied[later][at]
    fate[tied[later]] = second[group[tied[later]]]
    return order, fate


def _segments(block: int, held: list[tuple[np.ndarray, bytes]], spec: Windows, bits: int) -> pa.RecordBatch:
    """Rows (bucket, block, kind, payload, bytes) of a block: segments by anchor (kind 0), at
    most two of the same bytes; the others are noted as sharing a fate (kind 2)."""
    entries = np.concatenate([e for e, _ in held])
    data = np.frombuffer(b"".join([d for _, d in held]), np.uint8)
    size = entries["size"].astype(np.int64)
    begin = np.cumsum(size) - size
    order, fate = _alike(entries, data, begin, spec)
    entries, begin, size = entries[order], begin[order], size[order]
    travels = fate == np.arange(len(fate))
    rows: list[tuple[int, int, bytes, bytes]] = []
    if not travels.all():
        follower, of = entries[~travels], entries[fate[~travels]]
        note = np.zeros(len(follower), FOLLOWER)
        for f in ("row", "start", "count"):
            note[f] = follower[f]
        note["of_row"], note["of_start"] = of["row"], of["start"]
        rows.append(((1 << bits) + block, 2, note.tobytes(), b""))
    entries, begin, size = entries[travels], begin[travels], size[travels]
    bucket = (entries["hash"] >> U64(64 - bits)).astype(np.int64)
    rows += [(int(bucket[a]), 0, entries[a:b].tobytes(), _joined(data, begin[a:b], begin[a:b] + size[a:b])) for a, b in _cuts(bucket)]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([block] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())],
        names=["bucket", "block", "kind", "payload", "bytes"],
    )


#: bytes of segments, size of each, its windows, doc and start -> repeated windows
Solver = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _solve_bucket(table: pa.Table, spec: Windows, solver: Solver) -> pa.Table:
    """Runs of repeated windows of a bucket's segments, by block (kind 1); what a block
    says of itself passes."""
    kinds, blocks = table.column("kind").to_numpy(), table.column("block").to_numpy()
    if kinds[0] > 0:
        return table.select(["block", "kind", "payload"])
    parts = [np.frombuffer(p, ENTRY) for p in table.column("payload").to_pylist()]
    data = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8)
    entries = np.concatenate(parts)
    owner = np.repeat(blocks, [len(p) for p in parts])
    size = entries["size"].astype(np.int64)
    place = np.cumsum(size) - size
    order, fate = _alike(entries, data, place, spec)
    entries, owner, place, size = entries[order], owner[order], place[order], size[order]
    live = np.flatnonzero(fate == np.arange(len(fate)))
    # segments of one anchor stay together; about ``TOGETHER`` bytes are solved at a time
    weight, hashes, cuts = np.cumsum(size[live]), entries["hash"][live], [0]
    while cuts[-1] < len(live):
        to = int(np.searchsorted(weight, (weight[cuts[-1] - 1] if cuts[-1] else 0) + TOGETHER, "right"))
        to = min(max(to, cuts[-1] + 1), len(live))
        cuts.append(int(np.searchsorted(hashes, hashes[to - 1], "right")))
    of, offset, length = [], [], []
    for a, b in zip(cuts, cuts[1:]):
        own = live[a:b]
        count = entries["count"][own].astype(np.int64)
        joined = np.frombuffer(_joined(data, place[own], place[own] + size[own]), np.uint8)
        repeated = solver(joined, size[own], count, entries["doc"][own], entries["start"][own].astype(np.int64))
        segment = np.repeat(np.arange(b - a), count)
        opens = repeated.copy()
        opens[1:] &= ~(repeated[:-1] & (segment[1:] == segment[:-1]))
        closes = repeated.copy()
        closes[:-1] &= ~(repeated[1:] & (segment[1:] == segment[:-1]))
        at, to = np.flatnonzero(opens), np.flatnonzero(closes)
        of.append(own[segment[at]])
        offset.append(at - (np.cumsum(count) - count)[segment[at]])
        length.append(to - at + 1)
    of, offset, length = map(np.concatenate, (of, offset, length))  # by segment, ascending
    low, high = np.searchsorted(of, fate), np.searchsorted(of, fate, "right")
    many = high - low
    to = np.repeat(np.arange(len(fate)), many)
    at = np.repeat(low, many) + np.arange(len(to)) - np.repeat(np.cumsum(many) - many, many)
    runs = np.zeros(len(to), RUN)
    runs["row"], runs["start"], runs["count"] = entries["row"][to], entries["start"][to] + offset[at], length[at]
    by = np.argsort(owner[to], kind="stable")
    runs, own = runs[by], owner[to][by]
    cut = _cuts(own)
    return pa.table({"block": pa.array([int(own[a]) for a, _ in cut], pa.int64()), "kind": pa.array([1] * len(cut), pa.int32()), "payload": pa.array([runs[a:b].tobytes() for a, b in cut], pa.binary())})


def repeated_windows(docs: DataFrame, spec: Windows, tokenise: Tokenise, solver: Solver, block_bytes: int | None = None) -> tuple[DataFrame, str]:
    """The blocks' table, and the folder in which ``block_runs`` finds repeated windows."""
    spark = docs.sparkSession
    root = work_dir(spark)
    blocks = write_blocks(docs, f"{root}/blocks", block_bytes or block_size(docs))
    bits, partitions = bits_for(blocks.agg(F.sum("n_bytes")).first()[0] or 0), partitions_of(blocks)
    source = blocks.select("block", "row", "doc_id", "text")
    cold, warm = f"{root}/answers", f"{root}/windows"
    most = spec.hot

    def kinds(codes: np.ndarray, head: np.ndarray) -> np.ndarray:
        """1 for an anchor of too many surroundings."""
        return np.add.reduceat(np.int64(1) << codes, head) > most

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for block, piece in by_block(batches):
            if block != now and held:
                yield hash_rows(now, *surroundings(*map(np.concatenate, zip(*held))), bits)
                held = []
            now = block
            runs = Runs(tokenise(*buffers(piece.column(3))), spec)
            held.append((runs.hash, runs.content, runs.again))
        if held:
            yield hash_rows(now, *surroundings(*map(np.concatenate, zip(*held))), bits)

    # no name holds on to a finished step, whose shuffle files could then not be let go
    write_answers(shared_hashes(source.mapInArrow(frugal(anchors), "bucket long, block long, payload binary"), kinds), cold, partitions)
    settle(spark)

    def hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, shared = None, [], None
        for block, piece in by_block(batches):
            if block != now:
                if held:
                    yield hash_rows(now, *counted(np.concatenate(held)), bits)
                now, held, shared = block, [], Shared(cold, block, bits)
            if (shared.kinds > 0).any():
                tokens = tokenise(*buffers(piece.column(3)))
                runs = Runs(tokens, spec)
                of = np.flatnonzero(shared.find(runs.hash) > 0)
                if len(of):
                    held.append(_hot_windows(tokens, runs, of, spec)[2])
        if held:
            yield hash_rows(now, *counted(np.concatenate(held)), bits)

    any_hot = spark.read.schema("top long").parquet(f"{cold}/of-*").where("top > 0").limit(1).count() > 0
    if any_hot:
        write_answers(shared_hashes(source.mapInArrow(frugal(hot), "bucket long, block long, payload binary")), warm, partitions)
        settle(spark)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, shared, windows = None, [], None, None
        for block, piece in by_block(batches):
            if block != now:
                if held:
                    yield _segments(now, held, spec, bits)
                now, held, shared = block, [], Shared(cold, block, bits)
                windows = Shared(warm, block, bits) if any_hot else None
            if not len(shared.keys):
                continue
            tokens = tokenise(*buffers(piece.column(3)))
            runs = Runs(tokens, spec)
            kind = shared.find(runs.hash)
            if (kind >= 0).any():
                held.append(_piece_entries(piece, tokens, runs, kind, windows, spec))
        if held:
            yield _segments(now, held, spec, bits)

    cut = source.mapInArrow(frugal(segments), "bucket long, block long, kind int, payload binary, bytes binary")
    solved = cut.groupBy("bucket").applyInArrow(frugal_group(lambda t: _solve_bucket(t, spec, solver)), "block long, kind int, payload binary")
    write_answers(solved, f"{root}/solved", partitions)
    for done in (cold, warm):
        remove(spark, done)
    settle(spark)
    return blocks, root


def block_runs(root: str, block: int) -> np.ndarray:
    """A block's runs of repeated windows, sorted by row and start."""
    rows = read_answers(f"{root}/solved", block, ["kind", "payload"])
    runs = np.concatenate([np.zeros(0, RUN), *[np.frombuffer(r["payload"], RUN) for r in rows if r["kind"] == 1]])
    runs = runs[np.lexsort((runs["start"], runs["row"]))]
    follow = np.concatenate([np.zeros(0, FOLLOWER), *[np.frombuffer(r["payload"], FOLLOWER) for r in rows if r["kind"] == 2]])
    if len(follow) and len(runs):
        key = (runs["row"].astype(np.int64) << 32) | runs["start"]
        of = (follow["of_row"].astype(np.int64) << 32) | follow["of_start"]
        low, high = np.searchsorted(key, of), np.searchsorted(key, of + follow["count"])
        many = high - low
        at = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        more = runs[at].copy()
        more["row"] = np.repeat(follow["row"], many)
        more["start"] += np.repeat(follow["start"] - follow["of_start"], many)
        runs = np.concatenate([runs, more])
        runs = runs[np.lexsort((runs["start"], runs["row"]))]
    return runs


def covered(runs: np.ndarray, rows: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a piece (rows numbered on from ``rows[0]``) that repeated windows cover, as
    disjoint spans [begin, end) in order, and the piece's document of each."""
    if not len(rows) or not len(runs):
        return (np.zeros(0, np.int64),) * 3
    of = runs[np.searchsorted(runs["row"], rows[0]) : np.searchsorted(runs["row"], rows[-1], "right")]
    doc = (of["row"] - rows[0]).astype(np.int64)
    begin = first[doc] + of["start"].astype(np.int64)
    reach = np.maximum.accumulate(begin + of["count"] + window - 1)
    new = np.ones(len(begin), bool)
    new[1:] = (begin[1:] > reach[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    return begin[head], reach[np.append(head[1:], len(reach)) - 1] if len(head) else reach, doc[head]
