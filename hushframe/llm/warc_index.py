"""WARC archives with a two-level capture index.

Writing: pages whose payload equals that of a page with a smaller id become revisits of
it.  Pages lie in blocks, which are written once and not shuffled; digests and places alone
find what is equal (partial aggregates first, a digest of very many pages is dealt over
several keys), and each block reads its marks beside it.  Every task writes one gzip member a
record to a file of its own attempt, so a repeated task never disturbs what an index
line points at, and returns the records' places.

Index: lines "reversed-host key, time, page, place" are range-partitioned and sorted;
each ``LINES`` lines make one compressed block, and the sparse directory keeps a block's
first line key.  A look-up bisects the directory, then the block's lines, then reads one
range of one archive.

Defined results: a null html is an empty payload, a null url has the key "-".  Of rows
that share the smallest id of a payload all are responses; a payload whose rows all have
null ids has responses only.  Rows repeated with one id and url are written and found each.
An empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .jaccard_trie import _dealt_join as dealt_join
from .shared_windows import block_size, by_block, filesystem, partitions_of, read_answers, remove, settled_result, work_dir, write_answers, write_blocks
from .textbatch import frugal, pick

LINES = 1000
RANGE_ROWS = 1 << 20
ARCHIVE_BYTES = 256 << 20
TIME = "20240101000000"
MOST_OPEN = 32
#: As in the index key: blanks and control characters of an address.
_SPACE = re.compile(r"[\x00-\x20]")
#: Look-ups whose records are returned together.
TOGETHER = 500


def url_key(url: Column) -> Column:
    """Reversed-host key: http://a.B.org:80/x?y -> "org,b,a)/x?y"; null gives "-"."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[\x00-\x20]", "%20")
    host = F.lower(F.regexp_extract(bare, r"^([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":(80|443)?$", "")
    rest = F.regexp_extract(bare, r"^[^/?#]*([^#]*)", 1)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest), F.lit("-"))


def page_mark(page_id: Column) -> Column:
    """Sortable text of an id; a null id comes first."""
    return F.when(page_id.isNull(), F.lit("-")).otherwise(F.lpad((page_id.cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("string"), 20, "0"))


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers: int | None) -> bytes:
    """One WARC record.  A revisit has the response's head only, with the full length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = head + payload if kind == "response" else head
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {TIME[:4]}-{TIME[4:6]}-{TIME[6:8]}T00:00:00Z",
        f"WARC-Target-URI: {_SPACE.sub('%20', url or '-')}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of one record; a response's payload is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or base32(payload) != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: payload and digest differ")
    page = lambda x: None if x in (None, "<urn:page:None>") else int(x[10:-1])
    return {"page_id": page(fields["WARC-Record-ID"]), "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": page(fields.get("WARC-Refers-To")), "payload": payload if kind == "response" else None}


def base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_archives(pages: DataFrame, root: str, min_payload: int = 0, level: int = 1) -> DataFrame:
    """Write every page as a WARC record under ``root``; (mark, key, page, file, offset, length)."""
    spark = pages.sparkSession
    # html stays in its block: only places and digests travel, and marks come back beside it
    source = pick(pages, "page_id", "url", "html").select(F.col("page_id").alias("doc_id"), F.coalesce(F.col("html"), F.lit("")).alias("text"), "url")
    blocks = write_blocks(source, f"{root}/blocks", block_size(source), whole=True).withColumnRenamed("x0", "url")
    digests = blocks.where(F.col("n_bytes") >= min_payload).select("block", "row", F.col("doc_id").alias("page_id"), F.sha1(F.col("text").cast("binary")).alias("digest"))
    digests.write.parquet(f"{root}/digests")
    digests = spark.read.parquet(f"{root}/digests")
    first = digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("m")).where("m > 1 and first is not null").select("digest", "first")
    keyed = digests.withColumn("key", F.struct("block", "row"))
    marks = dealt_join(keyed, first, ["digest"]).where("page_id <> first or page_id is null").select("block", "row", "first")
    write_answers(marks, f"{root}/marks", partitions_of(blocks))
    typed = blocks.select("block", "row", F.col("doc_id").alias("page_id"), "text", "url", url_key(F.col("url")).alias("key"), page_mark(F.col("doc_id")).alias("page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = filesystem(root)
        fs.create_dir(f"{base}/archives", recursive=True)
        out, name, at = None, "", 0
        now, known = None, {}
        try:
            for block, batch in by_block(batches):
                if block != now:
                    now, known = block, {r["row"]: r["first"] for r in read_answers(f"{root}/marks", block, ["row", "first"])}
                places = []
                for row, page_id, html, url in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4))):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"archives/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    payload = html.encode()
                    raw = record("revisit" if row in known else "response", page_id, url, payload, base32(payload), known.get(row))
                    packed = gzip.compress(raw, level, mtime=0)
                    out.write(packed)
                    places.append((name, at, len(packed)))
                    at += len(packed)
                names, offsets, lengths = zip(*places) if places else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(5), batch.column(6), pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["key", "page", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    places = typed.mapInArrow(frugal(run), "key string, page string, file string, offset long, length long")
    places.write.parquet(f"{root}/places")  # the writes happen once, with the rows that point at them
    for done in ("blocks", "digests", "marks"):
        remove(spark, f"{root}/{done}")
    return spark.read.parquet(f"{root}/places")


def ranges(rows: DataFrame) -> int:
    """Range partitions: as many as the session has for a shuffle, or so many that each has
    ``RANGE_ROWS`` rows."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))


def write_index(places: DataFrame, root: str, lines: int = LINES) -> DataFrame:
    """Sorted, compressed blocks of index lines; returns the directory (first, file, offset, length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(root)
        fs.create_dir(f"{base}/index", recursive=True)
        held: list[str] = []
        name, at, out, rows = f"index/cdx-{uuid.uuid4().hex}.gz", 0, None, []

        def block() -> None:
            nonlocal at, out
            out = out or fs.open_output_stream(f"{base}/{name}", compression=None)
            packed = gzip.compress("".join(held).encode(), 6, mtime=0)
            out.write(packed)
            rows.append((" ".join(held[0].split(" ", 3)[:3]), name, at, len(packed)))
            at += len(packed)
            held.clear()

        for batch in batches:
            for key, page, file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                place = json.dumps({"filename": file, "offset": offset, "length": length}, separators=(",", ":"))
                held.append(f"{key} {TIME} {page} {place}\n")
                if len(held) == lines:
                    block()
        if held:
            block()
        if out is not None:
            out.close()
        columns = list(zip(*rows)) if rows else [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], names=["first", "file", "offset", "length"])

    n = ranges(places)
    ordered = places.repartitionByRange(n, "key", "page").sortWithinPartitions("key", "page", "file", "offset")
    ordered.mapInArrow(frugal(run), "first string, file string, offset long, length long").sortWithinPartitions("first").write.parquet(f"{root}/directory")
    return places.sparkSession.read.parquet(f"{root}/directory")


def directory_files(spark: SparkSession, root: str) -> list[tuple[str, str, str]]:
    """(first key, last key, address) of each file of the sparse directory, in order: one row
    a task that wrote the index, so it is small whatever the number of pages."""
    rows = spark.read.parquet(f"{root}/directory").groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min("first").alias("a"), F.max("first").alias("z")).collect()
    return sorted((r["a"], r["z"], r["path"]) for r in rows)


class CaptureIndex:
    """Look-ups in an index by binary search; used in tasks and on the driver.  One is
    opened a task; it reads a file of the directory when a key falls into it, and keeps
    the last one, as keys come in order."""

    def __init__(self, root: str, directory: list[tuple[str, str, str]]):
        self.fs, self.base = filesystem(root)
        self.begins = [a for a, _, _ in directory]
        self.parts = [path for _, _, path in directory]
        self.part: tuple[int, list[str], list[list]] = (-1, [], [])
        self.files: OrderedDict[str, object] = OrderedDict()
        self.block: tuple[tuple[int, int], list[str]] = ((-1, -1), [])

    def open_part(self, i: int) -> tuple[list[str], list[list]]:
        if self.part[0] != i:
            fs, path = filesystem(unquote(self.parts[i]))
            table = pq.read_table(path, filesystem=fs, columns=["first", "file", "offset", "length"], partitioning=None)
            first = table["first"].to_pylist()
            order = sorted(range(len(first)), key=first.__getitem__)
            self.part = (i, [first[j] for j in order], [table[c].take(pa.array(order)).to_pylist() for c in ("file", "offset", "length")])
        return self.part[1], self.part[2]

    def read(self, file: str, offset: int, length: int) -> bytes:
        """One range of one file."""
        handle = self.files.get(file)
        if handle is None:
            if len(self.files) >= MOST_OPEN:
                self.files.popitem(last=False)[1].close()
            handle = self.files[file] = self.fs.open_input_file(f"{self.base}/{file}")
        self.files.move_to_end(file)
        handle.seek(offset)
        return handle.read(length)

    def lines(self, part: int, i: int) -> list[str]:
        if self.block[0] != (part, i):
            raw = self.read(*(w[i] for w in self.open_part(part)[1]))
            self.block = ((part, i), gzip.decompress(raw).decode().split("\n")[:-1])
        return self.block[1]

    def find(self, key: str) -> Iterator[str]:
        """Lines that begin with ``key`` and a space, in order."""
        probe = key + " "
        part = max(0, bisect.bisect_left(self.begins, probe) - 1)
        while part < len(self.parts):
            first, _ = self.open_part(part)
            i = max(0, bisect.bisect_left(first, probe) - 1)
            while i < len(first):
                if first[i] >= probe and not first[i].startswith(key):
                    return
                lines = self.lines(part, i)
                at = bisect.bisect_left(lines, probe)
                while at < len(lines) and lines[at].startswith(probe):
                    yield lines[at]
                    at += 1
                if at < len(lines):
                    return
                i += 1
            part += 1

    def records(self, key: str) -> Iterator[dict]:
        """The records of a line key prefix ("url-key", "url-key time" or "url-key time page")."""
        for line in self.find(key):
            place = json.loads(line[line.index("{") :])
            yield parse(zlib.decompress(self.read(place["filename"], place["offset"], place["length"]), 31))


def read_back(pages: DataFrame, root: str, with_payload: bool = False) -> DataFrame:
    """Look every page up by its url and id and read its record: page_id, payload_bytes,
    payload_digest, record_type, refers_to."""
    wanted = pick(pages, "page_id", "url").select(url_key(F.col("url")).alias("key"), page_mark(F.col("page_id").cast("long")).alias("page")).distinct()
    n = ranges(pages)
    wanted = wanted.repartitionByRange(n, "key", "page").sortWithinPartitions("key", "page")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload

    directory = directory_files(pages.sparkSession, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CaptureIndex(root, directory)
        for batch in batches:
            keys = [f"{k} {TIME} {p}" for k, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            for at in range(0, len(keys), TOGETHER):
                rows = [{c: r[c] for c in names} for k in keys[at : at + TOGETHER] for r in index.records(k)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, types)], names=names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return wanted.mapInArrow(frugal(run), schema)


def archive_round_trip(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Write archives and index into the shared folder, read every page back, and delete
    them; the rows that were read stay there (``release`` deletes them)."""
    root = work_dir(pages.sparkSession)
    write_index(write_archives(pages, root, min_payload), root)
    remove(pages.sparkSession, f"{root}/places")
    return settled_result(read_back(pages, root), root, "archives", "index", "directory")


def lookup(spark: SparkSession, root: str, url: str) -> list[dict]:
    """All captures of one url, on the driver."""
    key = spark.range(1).select(url_key(F.lit(url)).alias("k")).first()["k"]
    return list(CaptureIndex(root, directory_files(spark, root)).records(key))
