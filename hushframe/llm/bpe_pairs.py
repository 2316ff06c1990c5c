"""BPE encoding and decoding with a pair occurrence index.

A piece of a partition is normalised and cut into words; its distinct words that
were not met before are encoded together: one symbol array, and for every adjacent
pair that has a rank the list of all its positions.  Active ranks are taken in
ascending order from a heap; all occurrences of the pair merge, and the lists of
the pairs that this makes or breaks are updated.  Words met before come from a
bounded cache in the Python worker.

The vocabulary file (the ``tokenizers`` JSON format, model BPE with an end-of-word
suffix, NFC / white space / lower-case normaliser, byte-level symbols, no decoder) is
read from a path given as parameter; its content is broadcast and never stored here.

Defined results: null is the empty text: no ids, hashes of the empty string; an empty
table gives no rows.  Repeated rows and null ids give a row each; very long texts are
encoded whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import frugal, pick, pieces, small_batches

#: Fixed value: Unicode White_Space, which the normaliser makes a plain space.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BEYOND = re.compile("[^\x00-\u024f]")
_CACHE_WORDS = 200_000
#: Words of so many bytes of text are encoded together.
TOGETHER_BYTES = 2 << 20


def byte_symbols() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the
    others for code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {b: chr(b) for b in plain}
    for b in range(256):
        chars.setdefault(b, chr(256 + len(chars) - len(plain)))
    return [chars[b] for b in range(256)]


@dataclass(frozen=True)
class Vocabulary:
    """Ids of symbols and words' ends, merges as (left id, right id) -> (rank, id)."""

    tokens: tuple[str, ...]
    merges: dict[tuple[int, int], tuple[int, int]]
    inner: tuple[int, ...]  # byte -> id inside a word
    last: tuple[int, ...]  # byte -> id at a word's end
    special: tuple[tuple[str, int], ...]
    pattern: str

    @classmethod
    def parse(cls, text: str) -> "Vocabulary":
        data = json.loads(text)
        model = data["model"]
        vocab, suffix = dict(model["vocab"]), model.get("end_of_word_suffix") or ""
        added = {t["content"]: t["id"] for t in data.get("added_tokens", ())}
        tokens = [""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in (vocab | added).items():
            tokens[i] = token
        merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ", 1)
            merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        symbols = byte_symbols()
        split = next(p["pattern"]["Regex"] for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        return cls(tuple(tokens), merges, tuple(vocab.get(c, -1) for c in symbols), tuple(vocab.get(c + suffix, -1) for c in symbols), tuple(sorted(added.items(), key=lambda x: -len(x[0]))), split)

    def in_order(self) -> bool:
        """Whether every pair that a merge can make ranks after that merge, so that taking
        all occurrences of a rank at once gives what merging one at a time gives."""
        last_made: dict[int, int] = defaultdict(lambda: -1)
        for rank, made in self.merges.values():
            last_made[made] = max(last_made[made], rank)
        return all(rank > max(last_made[a], last_made[b]) for (a, b), (rank, _) in self.merges.items())


class PairRanks:
    """Merges as arrays: sorted pair keys to ranks, and the pair and result of each rank."""

    def __init__(self, vocab: Vocabulary):
        self.size = len(vocab.tokens) + 1
        pairs = sorted(vocab.merges.items(), key=lambda x: x[1][0])
        self.left = [p[0] for p, _ in pairs]
        self.right = [p[1] for p, _ in pairs]
        self.made = [m[1] for _, m in pairs]
        keys = np.array(self.left, np.int64) * self.size + np.array(self.right, np.int64)
        by = np.argsort(keys)
        self.keys, self.ranks = np.append(keys[by], np.iinfo(np.int64).max), np.append(by, -1).astype(np.int64)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it has none; a negative id is in no pair."""
        key = a * self.size + b
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], -1)


def _grouped(ranks: np.ndarray, where: np.ndarray) -> list[tuple[int, np.ndarray]]:
    live = ranks >= 0
    ranks, where = ranks[live], where[live]
    if not len(ranks):
        return []
    by = np.argsort(ranks, kind="stable")
    ranks, where = ranks[by], where[by]
    cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
    return list(zip(ranks[np.append(0, cuts)].tolist(), np.split(where, cuts)))


def encode_words(words: list[str], vocab: Vocabulary, ranks: PairRanks) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct, non-empty words, joined, and where each word's ids begin and end."""
    raws = [w.encode("utf-8", "surrogatepass") for w in words]
    size = np.array([len(r) for r in raws], np.int64)
    raw = np.frombuffer(b"".join(raws), np.uint8)
    word = np.repeat(np.arange(len(words)), size)
    ids = np.array(vocab.inner, np.int64)[raw]
    ends = np.cumsum(size) - 1
    ids[ends] = np.array(vocab.last, np.int64)[raw[ends]]
    word, ids = word[ids >= 0], ids[ids >= 0]
    # a mark after each word keeps pairs inside words
    at = np.arange(len(ids)) + word
    n = len(ids) + len(words)
    symbols = np.full(n + 1, -1, np.int64)
    symbols[at] = ids
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[n] = n
    before[0] = n
    index: dict[int, list[np.ndarray]] = defaultdict(list)
    for rank, where in _grouped(ranks.of(symbols[:-1], symbols[1:]), np.arange(n)):
        index[rank].append(where)
    active = list(index)
    heapq.heapify(active)
    while active:
        rank = heapq.heappop(active)
        lists = index.pop(rank)
        a, b, made = ranks.left[rank], ranks.right[rank], ranks.made[rank]
        pos = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
        right = after[pos]
        live = (symbols[pos] == a) & (symbols[right] == b)
        pos, right = pos[live], right[live]
        if a == b and len(pos) > 1:  # of overlapping occurrences the leftmost merge
            taken, keep = -1, np.zeros(len(pos), bool)
            for i, (p, r) in enumerate(zip(pos.tolist(), right.tolist())):
                keep[i] = p != taken
                if keep[i]:
                    taken = r
            pos, right = pos[keep], right[keep]
        if not len(pos):
            continue
        beyond = after[right]
        symbols[pos], symbols[right] = made, -2
        after[pos] = beyond
        before[beyond] = pos
        left = before[pos]
        new = np.concatenate([ranks.of(np.full(len(pos), made), symbols[beyond]), ranks.of(symbols[left], np.full(len(pos), made))])
        for r, where in _grouped(new, np.concatenate([pos, left])):
            if r not in index:
                heapq.heappush(active, r)
            index[r].append(where)
    alive = np.flatnonzero(symbols[:n] != -2)
    marks = np.flatnonzero(symbols[alive] == -1)
    kept = np.delete(symbols[alive], marks)
    return kept, np.append(0, marks - np.arange(len(marks)))


def latin_pattern(pattern: str) -> re.Pattern | None:
    """The word pattern for the ``re`` module, with the letters and numbers of the code
    points up to U+024F spelt out; exact for texts that have no others."""

    def spelt(kind: str) -> str:
        codes = [c for c in range(0x250) if unicodedata.category(chr(c))[0] == kind]
        return "".join(f"\\u{c:04x}" for c in codes)

    if "\\p{L}" not in pattern:
        return None
    try:
        text = re.sub(r"\[(\\p\{[LN]\})\]", r"[\1]", pattern)
        text = text.replace("\\p{L}", spelt("L")).replace("\\p{N}", spelt("N")).replace("\\s", "\\t-\\r \\x85\\xa0")
        return None if "\\p" in text else re.compile(text)
    except re.error:
        return None


class Encoder:
    """Encodes and decodes texts with one vocabulary; holds the word cache."""

    def __init__(self, vocab: Vocabulary):
        if not vocab.in_order():
            raise ValueError("a merge of this vocabulary can make a pair of a lower rank; merging by rank would be inexact")
        self.vocab, self.ranks = vocab, PairRanks(vocab)
        pattern = vocab.pattern.replace("\\s", _SPACE)
        self.words, self.latin = regex.compile(pattern, regex.V0), latin_pattern(vocab.pattern)
        self.marks = re.compile("|".join(re.escape(s) for s, _ in vocab.special)) if vocab.special else None
        self.special = dict(vocab.special)
        self.partial = min(*vocab.inner, *vocab.last) < 0
        self.ids: dict[str, str] = {}
        self.tokens: dict[str, str] = {}
        self.reset()

    def reset(self) -> None:
        """Empty the cache; special tokens stay, under a key that no word has."""
        self.ids = {" " + s: str(i) for s, i in self.special.items()}
        self.tokens = {" " + s: s for s in self.special}

    def cut(self, text: str) -> list[str]:
        """Words of a text without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                text = text.replace("Σ", "σ")  # lower-casing goes by code point, without a final form
        text = text.lower()
        if self.latin is not None and not _BEYOND.search(text):
            return self.latin.findall(text)
        return self.words.findall(text)

    def parts(self, text: str) -> list[str]:
        """Words in order; a special token is a part of its own, marked by a leading space."""
        if self.marks is None or not self.marks.search(text):
            return self.cut(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += self.cut(text[at : m.start()])
            out.append(" " + m[0])
            at = m.end()
        return out + self.cut(text[at:])

    def learn(self, words: set[str]) -> None:
        """Encode the words that are not in the cache, all together."""
        fresh = words - self.ids.keys()
        if len(self.ids) + len(fresh) > max(_CACHE_WORDS, len(words)):
            self.reset()
            fresh = words - self.ids.keys()
        if not fresh:
            return
        fresh = sorted(fresh)
        ids, bounds = encode_words(fresh, self.vocab, self.ranks)
        ids, names = ids.tolist(), self.vocab.tokens
        bounds = bounds.tolist()
        for i, w in enumerate(fresh):
            of = ids[bounds[i] : bounds[i + 1]]
            self.ids[w] = " ".join([str(x) for x in of])
            self.tokens[w] = " ".join([names[x] for x in of])

    def prepare(self, texts: list[str]) -> None:
        """Encode all words of the texts that are not known, together."""
        words: set[str] = set()
        for text in texts:
            words.update(self.parts(text))
        self.learn(words)

    def encode(self, text: str) -> tuple[str, str, int]:
        """Ids joined by a space, decoded text and number of ids of a prepared text."""
        parts = self.parts(text)
        if self.partial:  # words none of whose bytes has an id
            parts = [w for w in parts if self.ids[w]]
        ids = " ".join(map(self.ids.__getitem__, parts))
        return ids, " ".join(map(self.tokens.__getitem__, parts)), ids.count(" ") + 1 if ids else 0

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, as a tokenizer without a decoder does."""
        return " ".join(self.vocab.tokens[i] for i in ids)


@lru_cache(2)
def _encoder(text: str) -> Encoder:
    return Encoder(Vocabulary.parse(text))


def bpe_encode(docs: DataFrame, path: str, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with ``with_ids`` also ids (array of
    int), with ``with_text`` the decoded text.  ``path`` is read on the driver."""
    with open(path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: some MB
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def one(batch: pa.RecordBatch, encoder: Encoder) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        encoder.prepare(texts)
        rows = []
        for text in texts:  # a text's ids and tokens are let go once they are hashed
            ids, decoded, count = encoder.encode(text)
            rows.append((count, sha(ids), sha(decoded), [*map(int, ids.split())] if with_ids else None, decoded if with_text else None))
        names = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids, *["decoded"] * with_text]
        kept = [0, 1, 2, *[3] * with_ids, *[4] * with_text]
        types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], types[i]) for i in kept]], names=["doc_id", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        try:
            for batch in batches:
                for piece in pieces(batch, "text", TOGETHER_BYTES):
                    yield one(piece, encoder)
        finally:
            encoder.reset()  # the word cache doesn't outlive its task

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text
    small_batches(docs.sparkSession)
    source = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(frugal(run), schema)
