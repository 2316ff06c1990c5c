"""Plain versions of the text operators, for small inputs."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def repetition(text, least=5):
    w = WORD.findall(text or "")
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    three = [False] * len(w)
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            three[i] = three[i + 1] = three[i + 2] = True
    seen, lines = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    longest, covered, size = 0, [False] * len(w), least
    while True:
        at = collections.defaultdict(list)
        for i in range(len(w) - size + 1):
            at[tuple(w[i : i + size])].append(i)
        again = [i for own in at.values() if len(own) > 1 for i in own]
        if not again:
            break
        longest = size
        for i in again:
            covered[i : i + size] = [True] * size
        size += 1
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), lines, sum(three), longest, sum(covered)


def byte_repeats(rows, window=50):
    """rows: (doc_id, text) -> {index: (n_bytes, n_removed, n_spans, sha)}"""
    raw = [(d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in raw:
        for i in range(len(b) - window + 1):
            g = b[i : i + window]
            if d is not None:
                first[g] = min(first.get(g, d), d)
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        if d is not None:
            for i in range(len(b) - window + 1):
                if first[b[i : i + window]] < d:
                    gone[i : i + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)))
    return out


def passages(rows, window=20):
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            if d is not None:
                g = tuple(w[i : i + window])
                first[g] = min(first.get(g, (d, i)), (d, i))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        if d is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < (d, i):
                    gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    """rows: (doc_id, text) -> sorted (doc_id, n_shingles, component_id)."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i), d)) for i, (d, _) in enumerate(rows)]
