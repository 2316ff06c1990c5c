"""Exact substring deduplication over UTF-8 bytes with two-stage suffix sorting.

Segments of text around byte strings that occur more than once (``shared_windows``)
meet in one task and get a generalised suffix array in two stages: only suffixes
smaller than their successors are sorted directly (by eight bytes at a time, what is
still tied by the next eight); all others are induced by one scan over the buckets
of the first byte.  Adjacent common prefixes then split the array into classes of
suffixes that share ``window`` bytes; a member of a class is a repeat if the class
has a smaller doc_id.

Defined results: a null text is empty; an empty table gives no rows; documents with a
null id lose nothing and are no source; repeated rows with one id are one document, so
they don't remove each other; matches never cross documents; other columns are ignored.
Very long texts are whole: windows are cut from them in chunks of bounded memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared_windows import Tokens, Windows, block_runs, by_block, covered, repeated_windows, settled_result
from .textbatch import buffers, flagged, frugal, U64

WINDOW = 50
SPEC = Windows(window=WINDOW, gram=20, key_by_doc=True)
_KEEP = np.array([(0xFFFFFFFFFFFFFFFF << (8 * (8 - i))) & 0xFFFFFFFFFFFFFFFF for i in range(9)], U64)
#: An odd number for each byte, from which hashes of grams are made.
_CODE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


def tokenise(buf: np.ndarray, offs: np.ndarray) -> Tokens:
    return Tokens(lambda a, b: _CODE[buf[a:b]], buf, None, offs)


class SuffixArray:
    """Suffix array of segments, each ended by a mark smaller than every byte.

    With ``least`` only suffixes of that many bytes or more are asked for: shorter ones
    are sorted where a longer one is induced from them, and left out else.  With ``depth``
    suffixes that share so many bytes stay in order of place."""

    def __init__(self, tokens: np.ndarray, bounds: np.ndarray, least: int = 0, depth: int = 1 << 60):
        size = np.diff(bounds)
        n = len(tokens) + len(size)
        text = np.zeros(n + 16, np.uint8)
        shift = np.repeat(np.arange(len(size)), size)
        text[np.arange(len(tokens)) + shift] = tokens + 1  # UTF-8 has no byte 255
        self.text, self.n, self.depth = text, n, depth
        marks = bounds[1:] + np.arange(len(size))
        wide = text.astype(U64)
        for step in (1, 2, 4):
            wide[: len(wide) - step] = (wide[: len(wide) - step] << U64(8 * step)) | wide[step:]
        # characters from a suffix' start to its mark, the mark included
        self.left = np.repeat(marks, size + 1) - np.arange(n) + 1
        # the next eight characters, zeros from the mark on
        self.eight = wide[:n] & _KEEP[np.minimum(self.left, 8)]
        small = self._smaller()
        small[marks] = False  # marks are a bucket of their own, in order of place
        self.small, self.wanted = small, np.ones(n, bool)
        if least:
            self.wanted = self.left > least
            # after a segment's last asked suffix, those that it is induced from
            last = marks[size >= least] - least
            small[marks] = True
            stops = np.flatnonzero(small)
            small[marks] = False
            many = stops[np.searchsorted(stops, last, "right")] - last
            chain = np.repeat(last, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + 1
            self.wanted[chain] = True
        self.order = self._induced(self._direct(), marks[self.wanted[marks]])

    def chunk(self, at: np.ndarray, depth: int) -> np.ndarray:
        """Eight characters of each suffix from ``depth`` on, which lies before its end."""
        return self.eight[np.minimum(at + depth, self.n - 1)]

    def _smaller(self) -> np.ndarray:
        """Whether each suffix is smaller than its successor."""
        t = self.text[: self.n + 1].astype(np.int16)
        step = np.sign(t[1:] - t[:-1])
        at = np.where(step != 0, np.arange(self.n), self.n - 1)
        following = np.minimum.accumulate(at[::-1])[::-1]  # of equal bytes the end of the run decides
        return step[following] > 0

    def _direct(self) -> np.ndarray:
        at = np.flatnonzero(self.small & self.wanted)
        key = self.chunk(at, 0)
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        depth = 8
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        slots = np.flatnonzero(~(new & np.append(new[1:], True)))
        head = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))[slots]
        while depth < self.depth:
            # suffixes that ended are equal up to their marks and stay in order of place
            going = self.left[at[slots]] > depth
            slots, head = slots[going], head[going]
            if not len(slots):
                break
            key = self.chunk(at[slots], depth)
            by = np.lexsort((key, head))
            at[slots] = at[slots][by]
            key = key[by]
            new = np.ones(len(slots), bool)
            new[1:] = (key[1:] != key[:-1]) | (head[1:] != head[:-1])
            head = np.maximum.accumulate(np.where(new, slots, 0))
            tied = ~(new & np.append(new[1:], True))
            slots, head = slots[tied], head[tied]
            depth += 8
        return at

    def _induced(self, direct: np.ndarray, marks: np.ndarray) -> np.ndarray:
        text, induced = self.text, self.wanted & ~self.small
        own = np.split(direct, np.searchsorted(text[direct], np.arange(1, 256)))
        pending: list[list[np.ndarray]] = [[] for _ in range(256)]
        out = []
        for c in range(256):
            sorted_part = marks if c == 0 else own[c]
            waves = pending[c]
            wave = np.concatenate(waves) if waves else np.zeros(0, np.int64)
            bucket = []
            while len(wave):
                bucket.append(wave)
                before = wave[wave > 0] - 1
                wave = before[(text[before] == c) & induced[before]]  # a run of one byte induces its own bucket
            bucket.append(sorted_part)
            whole = np.concatenate(bucket)
            out.append(whole)
            before = whole[whole > 0] - 1
            first = text[before]
            go = (first > c) & induced[before]
            before, first = before[go], first[go]
            if len(before):
                by = np.argsort(first, kind="stable")
                before, first = before[by], first[by]
                cuts = np.flatnonzero(np.diff(first)) + 1
                for part in np.split(before, cuts):
                    pending[text[part[0]]].append(part)
            pending[c] = []
        return np.concatenate(out)

    def common_prefixes(self) -> np.ndarray:
        """Common prefix of each suffix with the one before it, marks apart."""
        lcp = np.zeros(len(self.order), np.int64)
        pairs = np.arange(1, len(self.order))
        depth = 0
        while len(pairs) and depth < self.depth:
            a, b = self.order[pairs - 1], self.order[pairs]
            most = np.minimum(self.left[a], self.left[b]) - 1 - depth  # bytes before the nearer mark
            differ = self.chunk(a, depth) ^ self.chunk(b, depth)
            same = np.where(differ == 0, 8, 0)
            odd = np.flatnonzero(differ)
            same[odd] = 7 - np.floor(np.log2((differ[odd] >> U64(1)).astype(np.float64) * 2 + 1)).astype(np.int64) // 8
            same = np.minimum(same, most)
            lcp[pairs] += same
            pairs = pairs[same == 8]
            depth += 8
        return lcp


def solve(data: np.ndarray, size: np.ndarray, count: np.ndarray, docs: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Flag a window (of the segments' windows in order) that a smaller document has too."""
    array = SuffixArray(data, np.append(0, np.cumsum(size)), window, window)
    lcp = array.common_prefixes()
    segment = np.repeat(np.arange(len(size)), size + 1)
    order = array.order
    new = lcp < window
    head = np.flatnonzero(new)
    doc = docs[segment[order]]
    least = np.repeat(np.minimum.reduceat(doc, head), np.diff(np.append(head, len(order))))
    flag = np.zeros(array.n, bool)
    flag[order] = doc > least
    # windows begin where ``window`` bytes are left before the mark
    return flag[array.left > window]


def remove_repeats(docs: DataFrame, with_text: bool = False, spec: Windows = SPEC, block_bytes: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``with_text`` also the bytes
    kept.  The rows are written to the shared folder (``release`` deletes them), all else
    that was written there is deleted."""
    blocks, root = repeated_windows(docs, spec, tokenise, solve, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None
        for block, piece in by_block(batches):
            if block != now:
                now, own = block, block_runs(root, block)
            buf, offs = buffers(piece.column(3))
            begin, end, doc = covered(own, piece.column(1).to_numpy(), offs, spec.window)
            n = len(offs) - 1
            removed = np.zeros(n, np.int64)
            np.add.at(removed, doc, end - begin)
            kept = buf[~flagged(begin, end, len(buf))].tobytes() if len(begin) else buf.tobytes()
            at = (offs - np.append(0, np.cumsum(removed))).tolist()
            parts = [kept[a:b] for a, b in zip(at, at[1:])]
            columns = [piece.column(2), pa.array(np.diff(offs)), pa.array(removed), pa.array(np.bincount(doc, minlength=n)), pa.array([hashlib.sha256(p).hexdigest() for p in parts])]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns.append(pa.array(parts, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    out = blocks.select("block", "row", "doc_id", "text").mapInArrow(frugal(run), schema)
    return settled_result(out, root, "blocks", "solved")
