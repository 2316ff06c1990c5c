"""Sets of word shingles of many documents at once."""

from __future__ import annotations

import hashlib

import numpy as np

from .textbatch import LOWER, U64, Words, buffers, exact_ids, mix, spaced

SIZE = 5


def normal_digests(buf: np.ndarray, offs: np.ndarray, words: Words) -> list[bytes]:
    """A 128-bit keyed digest of each text's words in order: texts that share it have the
    same words, so the same shingles."""
    keep = words.inside.copy()
    gap = words.end[words.end < len(buf)]
    keep[gap] = True  # one byte between words; where documents touch, the next one's first
    clean = np.where(words.inside, buf, 32)[keep]
    at = np.append(0, np.cumsum(keep))[offs]
    view = memoryview(clean.astype(np.uint8))
    return [hashlib.blake2b(bytes(view[a:b]).strip(b" "), digest_size=16, key=b"words").digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


class ShingleSets:
    """Distinct ``SIZE``-word shingles of each document of a piece (A-Z lower-cased), as
    64-bit hashes in ascending order.  A text of fewer words has its whole sequence as
    one shingle; one without words has none.

    ``n``: number of distinct shingles, counted by their words.  ``value`` holds distinct
    hashes, to find candidates; ``exact`` numbers the shingles of the piece by their words
    (``number`` in ``owner``), to compare sets."""

    def __init__(self, texts, size: int = SIZE, exact: bool = False):
        buf, offs = buffers(texts)
        buf = LOWER[buf]
        words = Words(buf, offs)
        n = np.diff(words.first)
        self.n_words, self.words, self.buf, self.offs = n, words, buf, offs
        h = words.hash
        # a shingle's hash folds its words in order, with its length
        count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
        doc = np.repeat(np.arange(len(n)), count)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + words.first[:-1][doc]
        width = np.minimum(n, size)[doc]
        value = width.astype(U64)
        for j in range(size):
            live = np.flatnonzero(width > j)
            value[live] = mix(value[live] + h[at[live] + j])
        # distinct in a document: sort by (document, hash)
        order = np.argsort(value)
        order = order[np.argsort(doc[order].astype(np.int32), kind="stable")]
        value, doc, at, width = value[order], doc[order], at[order], width[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
        ids = exact_ids(buf, words.start, words.end, h)
        twice = np.flatnonzero(~new)
        differ = (width[twice] != width[twice - 1]) if len(twice) else np.zeros(0, bool)
        for j in range(size):
            live = np.flatnonzero(~differ & (width[twice] > j)) if len(twice) else twice
            differ[live] |= ids[at[twice[live]] + j] != ids[at[twice[live] - 1] + j]
        self.n = np.bincount(doc[new], minlength=len(n))
        if differ.any():  # different words under one hash
            for d in np.unique(doc[twice[differ]]).tolist():
                own = np.flatnonzero(doc == d)
                self.n[d] = len({tuple(ids[a : a + w].tolist()) for a, w in zip(at[own].tolist(), width[own].tolist())})
        if exact:
            self.number, self.owner = self._numbers(ids, at, width, doc, size)
        self.value, self.doc = value[new], doc[new]
        self.first = np.searchsorted(self.doc, np.arange(len(n) + 1))

    @staticmethod
    def _numbers(ids: np.ndarray, at: np.ndarray, width: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Shingles numbered by their words, word by word; distinct (number, document)."""
        number = np.zeros(len(at), np.int64)
        for j in range(size):
            word = np.where(width > j, ids[np.minimum(at + j, max(len(ids) - 1, 0))] + 1, 0) if len(ids) else number
            number = np.unique((number << 32) | word, return_inverse=True)[1]
        both = np.unique((doc.astype(np.int64) << 32) | number)
        return both & 0xFFFFFFFF, both >> 32

    def digests(self) -> list[bytes]:
        return normal_digests(self.buf, self.offs, self.words)


def clear_texts(texts) -> tuple[np.ndarray, np.ndarray]:
    """Each text's lower-cased words with one space after each, and where each text begins."""
    buf, offs = buffers(texts)
    buf = LOWER[buf]
    words = Words(buf, offs, hashed=False)
    out, begin = spaced(buf, words)
    return out, begin[words.first]


def prefix_length(n: np.ndarray, num: int = 3, den: int = 4) -> np.ndarray:
    """Shingles of a set of ``n`` of which one at least is in any set with a Jaccard
    similarity of num / den or more, whatever the common order."""
    return np.where(n > 0, n - -(-n * num // den) + 1, 0)
