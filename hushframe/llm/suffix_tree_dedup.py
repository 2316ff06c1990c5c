"""Exact removal of repeated passages over words with prefix-partitioned suffix trees.

Segments around word windows that occur more than once (``shared_windows``) are dealt by
their anchor, six consecutive words, and meet in one task.  There the suffixes that hold
a whole window are split by prefixes of variable length: a group with more than ``GROUP``
suffixes is split by one more word until it fits.  Each group gets its own suffix tree
below its common prefix, as sorted suffixes with the branching depths between
neighbours.  Internal nodes of ``window`` words or more are the maximal repeats; every
leaf below one, but the first by (doc_id, start), is a repeat.

The corpus itself isn't dealt by prefixes of all its suffixes: each would have to carry
its 20 words, some 140 bytes for each word of some 7.

Words are numbered by their bytes, so trees compare words and no hashes.

Defined results: a null text has no words; an empty table gives no rows; documents with a
null id lose nothing and are no source; of repeated rows with one id and text neither
removes the other, as neither starts earlier; other columns are ignored.  Texts are
handled whole; windows of very long ones are cut in chunks of bounded memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared_windows import Tokens, Windows, block_runs, by_block, covered, repeated_windows, settled_result
from .textbatch import Words, buffers, exact_ids, flagged, frugal, spaced

WINDOW = 20
SPEC = Windows(window=WINDOW, gram=6, key_by_doc=False)
#: Suffixes of a group: its tree takes some hundred bytes for each.
GROUP = 1 << 12


def tokenise(buf: np.ndarray, offs: np.ndarray) -> Tokens:
    words = Words(buf, offs)
    data, begin = spaced(buf, words)
    return Tokens(lambda a, b: words.hash[a:b], data, begin, words.first)


def prefix_groups(words: np.ndarray, at: np.ndarray, window: int, group: int) -> Iterator[tuple[int, np.ndarray]]:
    """(prefix length, suffixes) of the variable-length prefix partition of suffixes ``at``."""
    todo = [(0, at)]
    while todo:
        depth, own = todo.pop()
        if len(own) <= group or depth >= window:
            yield depth, own
            continue
        key = words[own + depth]
        by = np.argsort(key)
        own, key = own[by], key[by]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(head, len(own)))
        for i in np.flatnonzero(size > group):
            todo.append((depth + 1, own[head[i] : head[i] + size[i]]))
        # prefixes that fit share no more words; they are packed together up to the limit
        fits = np.repeat(size <= group, size)
        own, size = own[fits], size[size <= group]
        pack = (np.cumsum(size) - size) // group
        for part in np.split(own, np.cumsum(size)[np.flatnonzero(np.diff(pack))]):
            if len(part):
                yield depth, part


class SuffixTree:
    """A tree over suffixes, each to its own end, that share their first ``known`` words:
    leaves in order, and the depth of the node at which each leaf branches off from the
    one before.  ``left``: words of each suffix from its start to its end."""

    def __init__(self, words: np.ndarray, at: np.ndarray, left: np.ndarray, known: int):
        order, branch = at.copy(), np.zeros(len(at), np.int64)
        new = np.zeros(len(at), bool)
        new[:1] = True
        depth = known
        slots = np.arange(len(at)) if len(at) > 1 else np.zeros(0, np.int64)
        while len(slots):
            group = np.cumsum(new)[slots]
            here = order[slots]
            ended = left[here] <= depth
            key = (group << 32) | np.where(ended, 0, words[np.minimum(here + depth, len(words) - 1)] + 1)
            by = np.argsort(key, kind="stable")
            order[slots] = here[by]
            key = key[by]
            apart = np.zeros(len(slots), bool)
            apart[1:] = (key[1:] != key[:-1]) & (key[1:] >> 32 == key[:-1] >> 32)
            branch[slots[apart]] = depth
            # leaves that end here are all the same string: they hang from one node
            same = np.zeros(len(slots), bool)
            same[1:] = (key[1:] == key[:-1]) & (key[1:] & 0xFFFFFFFF == 0)
            branch[slots[same]] = depth
            new[slots] |= apart | same
            depth += 1
            tied = ~(new & np.append(new[1:], True))
            slots = np.flatnonzero(tied)
        self.leaves, self.branch = order, branch

    def deep_nodes(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """First leaf and number of leaves of each topmost node of ``depth`` words or more."""
        head = np.flatnonzero(np.append(True, self.branch[1:] < depth)) if len(self.leaves) else np.zeros(0, np.int64)
        size = np.diff(np.append(head, len(self.leaves)))
        return head[size > 1], size[size > 1]

    def maximal_repeats(self, depth: int) -> dict[tuple[int, ...], int]:
        """(first leaf, last leaf) -> words, of every internal node of ``depth`` words or more."""
        found: dict[tuple[int, int], int] = {}
        stack: list[tuple[int, int]] = []  # first leaf, depth
        for i, d in enumerate([*self.branch[1:].tolist(), 0], 1):
            first = i - 1
            while stack and stack[-1][1] > d:
                first, own = stack.pop()
                found[(first, i - 1)] = own
            if d >= depth and (not stack or stack[-1][1] < d):
                stack.append((first, d))
        return found


def solve(data: np.ndarray, size: np.ndarray, count: np.ndarray, docs: np.ndarray, starts: np.ndarray, window: int = WINDOW, group: int | None = None) -> np.ndarray:
    """Flag a window (of the segments' windows in order) that starts earlier elsewhere."""
    own_words = Words(data, np.array([0, len(data)]))
    words = exact_ids(data, own_words.start, own_words.end, own_words.hash)
    length = count + window - 1
    first = np.cumsum(length) - length
    segment = np.repeat(np.arange(len(size)), count)
    offset = np.arange(len(segment)) - np.repeat(np.cumsum(count) - count, count)
    at = first[segment] + offset
    window_of = np.full(len(words), -1)
    window_of[at] = np.arange(len(at))
    left = np.zeros(len(words), np.int64)
    left[at] = length[segment] - offset
    flag = np.zeros(len(at), bool)
    for known, own in prefix_groups(words, at, window, group or GROUP):
        tree = SuffixTree(words, own, left, known)
        head, leaves = tree.deep_nodes(window)
        if not len(head):
            continue
        node = np.repeat(np.arange(len(head)), leaves)
        of = window_of[tree.leaves[np.repeat(head, leaves) + np.arange(leaves.sum()) - np.repeat(np.cumsum(leaves) - leaves, leaves)]]
        doc, start = docs[segment[of]], starts[segment[of]] + offset[of]
        by = np.lexsort((start, doc, node))
        least = by[np.cumsum(leaves) - leaves][node]
        flag[of] = (doc > doc[least]) | (start > start[least])
    return flag


def remove_passages(docs: DataFrame, with_text: bool = False, spec: Windows = SPEC, block_bytes: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256; with ``with_text`` also the words kept.  The
    rows are written to the shared folder (``release`` deletes them), all else that was
    written there is deleted."""
    blocks, root = repeated_windows(docs, spec, tokenise, solve, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None
        for block, piece in by_block(batches):
            if block != now:
                now, own = block, block_runs(root, block)
            buf, offs = buffers(piece.column(3))
            words = Words(buf, offs, hashed=False)
            begin, end, doc = covered(own, piece.column(1).to_numpy(), words.first, spec.window)
            n = np.diff(words.first)
            removed = np.zeros(len(n), np.int64)
            np.add.at(removed, doc, end - begin)
            out, place = spaced(buf, words, ~flagged(begin, end, len(words.start)) if len(begin) else None)
            data = out.tobytes()
            at = place[words.first - np.append(0, np.cumsum(removed))].tolist()
            parts = [data[a : b - 1] if b > a else b"" for a, b in zip(at, at[1:])]
            columns = [piece.column(2), pa.array(n), pa.array(removed), pa.array([hashlib.sha256(p).hexdigest() for p in parts])]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns.append(pa.array([p.decode() for p in parts]))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    out = blocks.select("block", "row", "doc_id", "text").mapInArrow(frugal(run), schema)
    return settled_result(out, root, "blocks", "solved")
