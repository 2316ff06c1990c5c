"""Quality rule on repetition inside a text, from a word-level suffix array.

Every piece of text gets one suffix array over word symbols (a symbol is a word
in its document, so a match can't leave the document), built by doubling the
compared length and re-sorting only suffixes that are still tied.  Adjacent
common prefixes give the lcp-intervals; those of ``min_repeat`` words or more
that can't be extended to the left are the maximal repeated substrings.  The
union of their occurrences gives the covered share.

Words and lines are compared by their bytes; hashes only bring candidates together.

Defined results: a null or empty text has no words, all counts 0, base_failed
true, kept false; an empty table gives no rows.  Repeated rows and null ids give a row
each.  Texts are handled whole; a very long text is one piece, some 25 bytes of memory
a byte of prose.  Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textbatch import Words, buffers, exact_ids, map_pieces, per_doc, pick

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, longest_repeat long, covered_words long, n_maximal_repeats long"
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class RepeatLimits:
    """``min_repeat``: words from which a repeat counts.  ``max_covered``: share
    of a text's words inside such repeats.  ``max_longest``: share of a text's
    words that its longest repeat may have, with ``long_repeat`` words always allowed."""

    min_repeat: int = 5
    max_covered: float = 0.5
    max_longest: float = 0.35
    long_repeat: int = 40


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of numbered symbols, and the ranks by 1, 2, 4, ... symbols.

    Each round sorts only the suffixes that share their rank with another one.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    head = np.flatnonzero(new)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.repeat(head, np.diff(np.append(head, n)))
    levels, step, slots = [rank.astype(np.int32)], 1, None
    tied = ~(new & np.append(new[1:], True))
    slots = np.flatnonzero(tied)  # places in the suffix array that are not settled
    while len(slots):
        at = order[slots]
        key = (rank[at] << 32) | (rank[np.minimum(at + step, n)] + 1)
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[slots] = at
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(at)))
        rank[at] = np.repeat(slots[head], size)
        slots = slots[np.repeat(size, size) > 1]
        step *= 2
        levels.append(rank.astype(np.int32))
    return order, levels


def adjacent_lcp(order: np.ndarray, levels: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Common prefix of the suffixes at places ``p - 1`` and ``p`` for each p of ``pairs``."""
    a, b, n = order[pairs - 1].astype(np.int64), order[pairs].astype(np.int64), len(order)
    lcp = np.zeros(len(pairs), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        rank = levels[k]
        while True:  # a run may hold the topmost length more than once
            x, y = np.minimum(a + lcp, n), np.minimum(b + lcp, n)
            same = (rank[x] == rank[y]) & (x < n) & (y < n)
            lcp[same] += 1 << k
            if k < len(levels) - 1 or not same.any():
                break
    return lcp


def maximal_intervals(order: np.ndarray, lcp: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lcp-intervals (first place, last place, length) whose occurrences are not all
    preceded by one symbol.  ``lcp[p]``: of places p - 1 and p, 0 where too short."""
    at = np.flatnonzero(lcp)
    if not len(at):
        return at, at, at
    left, right = at - 1, at + 1
    # nearest smaller values by pointer jumping; zeros bound every run
    smaller_l, smaller_r = np.arange(-1, len(lcp)), np.arange(1, len(lcp) + 2)
    full = np.append(lcp, 0)
    for near, go in ((smaller_l, left), (smaller_r, right)):
        live = np.arange(len(at))
        while len(live):
            live = live[full[go[live]] >= lcp[at[live]]]
            near[at] = go
            go[live] = near[go[live]]
    first, last = left, right - 1
    key = np.unique(first * np.int64(len(lcp) + 1) + last, return_index=True)[1]
    first, last, length = first[key], last[key], lcp[at][key]
    before = np.where(order > 0, symbols[order - 1], -1)
    changes = np.zeros(len(order) + 1, np.int64)
    np.cumsum(np.append(0, before[1:] != before[:-1]), out=changes[1:])
    diverse = changes[last + 1] > changes[first + 1]
    return first[diverse], last[diverse], length[diverse]


def deepest(n: int, first: np.ndarray, last: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each place the largest length of an interval over it, 0 outside all: an interval
    is two spans of a power of two, which pass their length on to their halves."""
    power = np.log2(last - first + 1).astype(np.int64)
    out = np.zeros(n, np.int64)
    for k in range(int(power.max(initial=0)), -1, -1):
        of = power == k
        np.maximum.at(out, first[of], length[of])
        np.maximum.at(out, last[of] - (1 << k) + 1, length[of])
        if k:
            half = 1 << (k - 1)
            lower = out.copy()
            lower[half:] = np.maximum(lower[half:], out[:-half])
            out = lower
    return out


def repeats(symbols: np.ndarray, doc: np.ndarray, first_word: np.ndarray, min_repeat: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: longest repeat, words covered by repeats, number of maximal repeats."""
    docs, n = len(first_word) - 1, len(symbols)
    longest, covered, count = np.zeros(docs, np.int64), np.zeros(docs, np.int64), np.zeros(docs, np.int64)
    if n < 2:
        return longest, covered, count
    order, levels = suffix_array(symbols)
    floor = levels[min(len(levels) - 1, max(0, min_repeat.bit_length() - 1))]
    pairs = 1 + np.flatnonzero(floor[order[1:]] == floor[order[:-1]])
    lcp = np.zeros(n, np.int64)
    lcp[pairs] = adjacent_lcp(order, levels, pairs)
    lcp[lcp < min_repeat] = 0
    first, last, length = maximal_intervals(order, lcp, symbols)
    if not len(first):
        return longest, covered, count
    owner = doc[order[first]]
    np.maximum.at(longest, owner, length)
    np.add.at(count, owner, 1)
    reach = np.zeros(n, np.int64)
    reach[order] = deepest(n, first, last, length)
    open_to = np.maximum.accumulate(np.where(reach > 0, np.arange(n) + reach, 0))
    covered[:] = per_doc(open_to > np.arange(n), first_word)
    return longest, covered, count


def measure(batch: pa.RecordBatch, limits: RepeatLimits) -> pa.RecordBatch:
    ids, (buf, offs) = batch.column(0), buffers(batch.column(1))
    words = Words(buf, offs)
    docs, n_words = len(offs) - 1, np.diff(words.first)
    chars = per_doc(words.inside & ((buf & 0xC0) != 0x80), offs)
    # a symbol is a word of a document, by its bytes; words of two documents differ
    own = exact_ids(buf, words.start, words.end, words.hash)
    symbols = np.unique((words.doc.astype(np.int64) << 32) | own, return_inverse=True)[1]
    three = np.zeros(len(symbols), bool)
    if len(symbols) > 2:
        pair = np.unique((symbols[:-1] << 32) | symbols[1:], return_inverse=True)[1]
        triple = (pair[:-1] << 32) | symbols[2:]
        whole = words.doc[:-2] == words.doc[2:]
        order = np.argsort(triple)
        same = triple[order[1:]] == triple[order[:-1]]
        again = np.zeros(len(triple), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        again &= whole
        for i in range(3):
            three[i : len(triple) + i] |= again
    ends = np.flatnonzero(buf == 10)
    starts = np.unique(np.concatenate([offs[:-1], ends + 1]))
    starts = starts[starts < len(buf)]
    # a line ends before the next one's start, without the \n between them
    following = np.append(starts[1:], len(buf))[: len(starts)]
    stops = following - (buf[following - 1] == 10) if len(starts) else starts
    lines = np.zeros(docs, np.int64)
    if len(starts):
        has = np.searchsorted(words.start, starts) < np.searchsorted(words.start, stops)
        starts, stops = starts[has], stops[has]
        owner = np.searchsorted(offs, starts, "right") - 1
        line = (owner.astype(np.int64) << 32) | exact_ids(buf, starts, stops)
        lines = np.bincount(owner, minlength=docs) - np.bincount(owner[np.unique(line, return_index=True)[1]], minlength=docs)
    n_repeat = per_doc(three, words.first)
    longest, covered, maximal = repeats(symbols, words.doc, words.first, limits.min_repeat)
    failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
    good = (covered <= limits.max_covered * n_words) & (longest <= np.maximum(limits.long_repeat, limits.max_longest * n_words))
    columns = [n_words, chars, per_doc(_SYMBOL[buf], offs), lines, n_repeat, failed, good & ~failed, longest, covered, maximal]
    return pa.RecordBatch.from_arrays([ids, *map(pa.array, columns)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def repetition_quality(docs: DataFrame, limits: RepeatLimits = RepeatLimits()) -> DataFrame:
    """One row per document with its counts and verdict; a single map over the scan."""
    source = pick(docs, "doc_id", "text").selectExpr("cast(doc_id as long) as doc_id", "text")
    return map_pieces(source, lambda batch: measure(batch, limits), SCHEMA)
