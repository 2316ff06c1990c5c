"""Exact n-gram Jaccard self-join with prefix trees, and its connected classes.

Documents link when their sets of five-word shingles have a Jaccard similarity of
``num / den`` or more.

1. Every block sends its distinct shingle hashes, packed by hash range; a bucket answers
   with those of two documents or more and a frequency class.  Nothing else of a text moves.
2. A set needs ``num / den`` of its shingles shared to have any link; the others are done.
   Of the rest, texts of the same words (a 128-bit keyed digest) collapse to their first.
3. In the common order (rarest class first, then by hash) two linked sets share one of
   their first shingles ("prefix"); each prefix shingle links its documents to the
   smallest of them, and the components of these links hold all pairs that can match.
4. The texts of a component meet in one task, which numbers words and shingles by their
   bytes and stores the sets in a trie, rarest shingle first.  A set is matched by walking
   the trie once: overlaps of shared paths are counted once, and subtrees are left when
   the shingles that remain can't reach the overlap that the lengths ask for, or when all
   below is in the set's class already.  Sets of a larger component walk it together, the
   likeliest to link first.  So every link counts real words.
5. Of a component of more than ``group`` shingles or ``SETS`` sets, sets whose shingles
   outside of it are too many for any link go, judged by sizes; the others are dealt into
   parts.  Each part is joined with itself and with the component's hubs, which every part
   has, so that a class that lies in several parts is one; then the sets outside the largest
   class meet all others, so no pair of different classes stays uncompared and no task holds
   more than two parts.

Defined results: null or empty texts have no shingles and no links; an empty table gives
no rows.  Repeated rows are documents of their own; null ids take part, and a class of only
null ids has none.  Texts are handled whole; other columns stay, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .components import connected_components
from .shared_windows import Shared, bits_for, block_size, by_block, counted, hash_rows, partitions_of, read_answers, remove, settle, settled_result, shared_hashes, work_dir, write_answers, write_blocks
from .shingle_sets import ShingleSets, clear_texts, prefix_length
from .textbatch import frugal, frugal_group, mix, U64

NUM, DEN = 3, 4
#: Shingles and sets that one part of a component may have: a part's work grows with the
#: square of its sets.
GROUP = 1 << 20
SETS = 1 << 12
ROW_BITS = 22
#: Keys over which the documents of one group are dealt when they meet its first.
SALTS = 16
#: Sets of a large component that all its parts have, and the share of a part they may take.
HUBS, HUB_SHARE = 32, 16
#: Steps of a doubling in which the sizes of a component's sets are told apart.
SIZE_STEPS = 32
#: Rows for each set of a large component that meet across its parts, as far as parts are
#: cut by sets.
COPIES = 4
#: Bytes of words that are cut into shingles together.
CUT_BYTES = 1 << 20
#: Sets that walk their trie one by one; more walk it together.
FEW = 24
#: Bytes of the table of shingles by sets that walk a trie together.
MEET = 4 << 20


class Trie:
    """Path-compressed trie of ordered sets; each node knows the lengths of the sets below it."""

    __slots__ = ("tokens", "children", "least", "most", "ends")

    def __init__(self, tokens: np.ndarray):
        self.tokens = tokens
        self.children: dict[int, Trie] = {}
        self.least, self.most = 1 << 60, 0
        self.ends: list[int] = []

    def note(self, size: int) -> None:
        self.least, self.most = min(self.least, size), max(self.most, size)


class Levels:
    """A finished trie as arrays, its nodes breadth first: a node's children lie together,
    and ``level`` holds where each depth begins."""

    def __init__(self, root: Trie, place: np.ndarray):
        nodes, parent, level = [root], [0], [0, 1]
        while level[-2] < level[-1]:
            for at in range(level[-2], level[-1]):
                below = nodes[at].children.values()
                nodes += below
                parent += [at] * len(below)
            level.append(len(nodes))
        self.level, self.parent = level[:-1], np.array(parent)
        self.n_children = np.array([len(n.children) for n in nodes])
        self.first_child = 1 + np.cumsum(self.n_children) - self.n_children
        self.least, self.most = np.array([n.least for n in nodes]), np.array([n.most for n in nodes])
        self.length = np.array([len(n.tokens) for n in nodes])
        self.start = np.cumsum(self.length) - self.length
        self.tokens = np.concatenate([n.tokens for n in nodes])
        self.depth = self.length.copy()
        for a, b in zip(self.level[1:], self.level[2:]):
            self.depth[a:b] += self.depth[self.parent[a:b]]
        self.n_ends = np.array([len(n.ends) for n in nodes])
        self.first_end = np.cumsum(self.n_ends) - self.n_ends
        self.ends = np.array([e for n in nodes for e in n.ends], np.int64)
        self.holder = np.repeat(np.arange(len(nodes)), self.n_ends)
        self.latest = self.gathered(np.maximum, place, -1)

    def gathered(self, merge: np.ufunc, value: np.ndarray, start: int) -> np.ndarray:
        """For each node ``merge`` over the values of all sets below it."""
        out = np.full(len(self.parent), start)
        merge.at(out, self.holder, value[self.ends])
        for a, b in zip(self.level[-2:0:-1], self.level[:0:-1]):
            merge.at(out, self.parent[a:b], out[a:b])
        return out


def _runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... ``count[0]`` of them, then those of first[1], ..."""
    return np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)


class TrieJoin:
    """Sets joined within one task.  ``sets`` hold ranks of the task's order, ascending;
    ``sizes`` are the full set sizes (shingles of one set only are left out of it)."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, num: int = NUM, den: int = DEN):
        self.sets, self.sizes, self.num, self.den = sets, sizes, num, den
        self.parent = list(range(len(sets)))
        self.root = Trie(np.zeros(0, np.int64))
        self.links: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def needed(self, x, y):
        """Smallest overlap of sets of x and y shingles that links them."""
        return -(-self.num * (x + y) // (self.num + self.den))

    def insert(self, i: int) -> None:
        tokens, at, node = self.sets[i], 0, self.root
        size = int(self.sizes[i])
        while True:
            node.note(size)
            if at == len(tokens):
                node.ends.append(i)
                return
            child = node.children.get(int(tokens[at]))
            if child is None:
                child = Trie(tokens[at:])
                node.children[int(tokens[at])] = child
                child.note(size)
                child.ends.append(i)
                return
            span = min(len(child.tokens), len(tokens) - at)
            differ = np.flatnonzero(child.tokens[:span] != tokens[at : at + span])
            same = int(differ[0]) if len(differ) else span
            if same < len(child.tokens):  # split the path
                low = Trie(child.tokens[same:])
                low.children, low.ends = child.children, child.ends
                low.least, low.most = child.least, child.most
                child.tokens = child.tokens[:same]
                child.children, child.ends = {int(low.tokens[0]): low}, []
            at, node = at + same, child

    def match(self, i: int) -> None:
        """Link set ``i`` with the sets of other classes in the trie that are similar to it."""
        x, size = self.sets[i], int(self.sizes[i])
        stack = [(self.root, 0, 0, 0)]  # node, shingles of x passed, of the path passed, overlap
        while stack:
            node, passed, depth, overlap = stack.pop()
            if len(node.tokens):
                at = np.searchsorted(x, node.tokens)
                hit = np.zeros(len(at), bool)
                inside = at < len(x)
                hit[inside] = x[at[inside]] == node.tokens[inside]
                overlap += int(hit.sum())
                depth += len(node.tokens)
                passed = int(np.searchsorted(x, node.tokens[-1], "right"))
            for e in node.ends:
                if self.find(e) != self.find(i) and overlap >= self.needed(size, int(self.sizes[e])):
                    self.links.append((i, e))
                    self.join(i, e)
            # the best that any set below can still reach
            low = max(node.least, -(-self.num * size // self.den))
            if low > node.most or node.least * self.num > size * self.den:
                continue
            if overlap + min(len(x) - passed, node.most - depth) < self.needed(size, low):
                continue
            stack += [(child, passed, depth, overlap) for child in node.children.values()]

    def match_together(self, some: np.ndarray, place: np.ndarray, trie: Levels) -> None:
        """Link the sets ``some`` with a later one (by ``place``) of every class in the trie
        that has one similar to it: one walk for all, in which a node is met by those that
        its subtrees may still have a link for."""
        label = np.array([self.find(i) for i in range(len(self.sets))])
        low, high = trie.gathered(np.minimum, label, len(label)), trie.gathered(np.maximum, label, -1)
        only = np.where(low == high, low, -1)  # class of all sets below, -1: several
        own, size, at = label[some], self.sizes[some], place[some]
        lengths = np.array([len(self.sets[i]) for i in some.tolist()])
        tokens, row = np.unique(np.concatenate([self.sets[i] for i in some.tolist()]), return_inverse=True)
        holds = np.zeros((len(tokens) + 1, len(some)), np.uint8)  # the last row: shingles that none has
        holds[row, np.repeat(np.arange(len(some)), lengths)] = 1
        passed = np.zeros((len(tokens) + 1, len(some)), np.int32)
        np.cumsum(holds[:-1], axis=0, out=passed[1:])
        shortest = -(-self.num * size // self.den)
        found = []
        nodes, overlap, live = np.zeros(1, np.int64), np.zeros((1, len(some)), np.int32), np.ones((1, len(some)), bool)
        while len(nodes):
            # what can be told without the path: class, lengths, and who was matched before
            live &= (only[nodes, None] != own) & (trie.latest[nodes, None] > at)
            live &= (np.maximum(trie.least[nodes, None], shortest) <= trie.most[nodes, None]) & (trie.least[nodes, None] * self.num <= size * self.den)
            some_live = live.any(axis=1)
            nodes, overlap, live = nodes[some_live], overlap[some_live], live[some_live]
            last = np.zeros((len(nodes), len(some)), np.int32)
            # so many paths at a time that their rows stay small
            step = np.cumsum(trie.length[nodes]) * len(some) // MEET
            for cut in np.split(np.arange(len(nodes)), np.flatnonzero(np.diff(step)) + 1):
                span = trie.length[nodes[cut]]
                cut, span = cut[span > 0], span[span > 0]
                if not len(cut):
                    continue
                path = trie.tokens[_runs(trie.start[nodes[cut]], span)]
                where = np.minimum(np.searchsorted(tokens, path), len(tokens) - 1)
                there = tokens[where] == path
                begin = np.cumsum(span) - span
                hit = np.append(0, np.cumsum(there))
                a, b = hit[begin], hit[begin + span]  # the shingles that any has, by node
                if len(full := np.flatnonzero(b > a)):
                    overlap[cut[full]] += np.add.reduceat(holds[where[there]], a[full], axis=0, dtype=np.int32)
                last[cut] = passed[np.searchsorted(tokens, path[begin + span - 1], "right")]
            ends = trie.n_ends[nodes]
            if ends.any():
                of = np.repeat(np.arange(len(nodes)), ends)
                e = trie.ends[_runs(trie.first_end[nodes], ends)]
                good = live[of] & (overlap[of] >= self.needed(size, self.sizes[e][:, None])) & (place[e][:, None] > at) & (label[e][:, None] != own)
                k, x = np.nonzero(good)
                found.append((x, e[k]))
            # the best that any set below can still reach
            best = overlap + np.minimum(lengths - last, (trie.most - trie.depth)[nodes, None])
            live &= best >= self.needed(size, np.maximum(trie.least[nodes, None], shortest))
            go = live.any(axis=1)
            below = trie.n_children[nodes[go]]
            up = np.repeat(np.flatnonzero(go), below)
            nodes, overlap, live = _runs(trie.first_child[nodes[go]], below), overlap[up], live[up]
        x, e = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        # one link to each class suffices
        first = np.unique(x * len(label) + label[e], return_index=True)[1]
        for i, j in zip(some[x[first]].tolist(), e[first].tolist()):
            if self.find(i) != self.find(j):
                self.links.append((i, j))
                self.join(i, j)

    def run(self, among: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Links that join all classes; ``among``: known class of each set."""
        if among is not None:
            first: dict[int, int] = {}
            for i, c in enumerate(among.tolist()):
                self.join(first.setdefault(c, i), i)
        if len(self.sets) <= FEW:
            for i in np.lexsort((np.arange(len(self.sets)), self.sizes)).tolist():
                self.match(i)
                self.insert(i)
            return self.links
        for i in range(len(self.sets)):
            self.insert(i)
        lengths = np.array([len(s) for s in self.sets])
        # sets with the fewest shingles of their own are the likeliest to be linked: what
        # they link is one class, which the sets after them need not meet again
        order = np.lexsort((np.arange(len(lengths)), -lengths / np.maximum(self.sizes, 1)))
        order = order[lengths[order] > 0]  # an empty set has no overlap
        place = np.full(len(lengths), -1)
        place[order] = np.arange(len(order))
        trie, done, width = Levels(self.root, place), 0, 4
        while done < len(order) - 1:
            # at most so many that their shingles' rows stay small
            rows = np.cumsum(lengths[order[done : done + width]]) * np.arange(1, 1 + len(order[done : done + width]))
            some = order[done : done + max(1, int(np.searchsorted(rows, MEET, "right")))]
            self.match_together(some, place, trie)
            done, width = done + len(some), min(2 * width, 128)
        return self.links


def _ranked(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """Each text's shared shingles as ascending ranks, rarest in this task first, and the
    number of all its shingles."""
    own = ShingleSets(pa.array(texts, pa.binary()), exact=True)
    number, owner = own.number, own.owner
    among = np.bincount(number)
    order = np.lexsort((np.arange(len(among)), among))
    rank = np.empty(len(among), np.int64)
    rank[order] = np.arange(len(among))
    shared = among[number] > 1
    number, owner = rank[number[shared]], owner[shared]
    by = np.lexsort((number, owner))
    return np.split(number[by], np.searchsorted(owner[by], np.arange(1, len(texts)))), own.n


def _join_group(table: pa.Table) -> pa.Table:
    keys = table.column("key").to_numpy()
    sets, sizes = _ranked([zlib.decompress(t) for t in table.column("words").to_pylist()])
    links = TrieJoin(sets, sizes).run(table.column("label").to_numpy() if "label" in table.column_names else None)
    pairs = keys[np.array(links, np.int64).reshape(-1, 2)]
    return pa.table({"u": pairs[:, 0], "v": pairs[:, 1]})


def _candidates(docs: DataFrame, root: str, block_bytes: int, whole: bool) -> DataFrame:
    """Every document: key, doc_id, n; those that may have a link also have the digest of
    their words (d1, d2) and the prefix of their shared shingles."""
    spark = docs.sparkSession
    blocks = write_blocks(docs, f"{root}/blocks", block_bytes, whole)
    bits = bits_for(2 * (blocks.agg(F.sum("n_bytes")).first()[0] or 0))
    source = blocks.select("block", "row", "doc_id", "text")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for block, piece in by_block(batches):
            if block != now and held:
                yield hash_rows(now, *counted(np.concatenate(held)), bits)
                held = []
            now = block
            held.append(ShingleSets(piece.column(3)).value)
        if held:
            yield hash_rows(now, *counted(np.concatenate(held)), bits)

    answers = f"{root}/answers"
    write_answers(shared_hashes(source.mapInArrow(frugal(send), "bucket long, block long, payload binary")), answers, partitions_of(blocks))
    settle(spark)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shared = None, None
        for block, piece in by_block(batches):
            if block != now:
                now, shared = block, Shared(answers, block, bits)
            sets = ShingleSets(piece.column(3))
            kind = shared.find(sets.value)
            own = np.bincount(sets.doc[kind >= 0], minlength=len(sets.n))
            may = (sets.n > 0) & (DEN * own >= NUM * sets.n)
            key = (np.int64(block) << ROW_BITS) | piece.column(1).to_numpy()
            digest = np.frombuffer(b"".join(sets.digests()), "<i8").reshape(-1, 2)
            prefix: list[np.ndarray | None] = [None] * len(may)
            length = prefix_length(sets.n, NUM, DEN)
            for i in np.flatnonzero(may):
                part = slice(sets.first[i], sets.first[i + 1])
                live = kind[part] >= 0
                v, k = sets.value[part][live], kind[part][live]
                # shingles of one document come before all others in the common order
                rest = int(length[i] - (sets.n[i] - own[i]))
                prefix[i] = v[np.lexsort((v, k))[: max(rest, 0)]].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), piece.column(2), pa.array(sets.n), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(prefix, pa.list_(pa.int64()))],
                names=["key", "doc_id", "n", "d1", "d2", "prefix"],
            )

    source.mapInArrow(frugal(keep), "key long, doc_id long, n long, d1 long, d2 long, prefix array<long>").write.parquet(f"{root}/sets")
    remove(spark, answers)
    settle(spark)
    return spark.read.parquet(f"{root}/sets")


def _placed(blocks: DataFrame, path: str) -> DataFrame:
    """(key, root, parts, part, words) of the texts that have a place, as compressed words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, {}
        for block, piece in by_block(batches):
            if block != now:
                now, known = block, {r["key"]: r for r in read_answers(path, block, ["key", "root", "parts", "part"])}
            keys = ((np.int64(block) << ROW_BITS) | piece.column(1).to_numpy()).tolist()
            at = [i for i, k in enumerate(keys) if k in known]
            if at:
                clear, begin = clear_texts(piece.column(3).take(pa.array(at)))
                view = memoryview(clear)
                rows = [known[keys[i]] for i in at]
                columns = [pa.array([r[c] for r in rows], pa.int64()) for c in ("key", "root", "parts", "part")]
                words = [zlib.compress(view[a:b], 1) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(words, pa.binary())], names=["key", "root", "parts", "part", "words"])

    return blocks.select("block", "row", "doc_id", "text").mapInArrow(frugal(run), "key long, root long, parts long, part long, words binary")


def _classes(docs: DataFrame, root: str, block_bytes: int, group: int, whole: bool) -> DataFrame:
    """(key, doc_id, n, class) of every document; class is null where it has no equal or link."""
    spark = docs.sparkSession
    everyone = _candidates(docs, root, block_bytes, whole)
    blocks = spark.read.parquet(f"{root}/blocks")
    held = everyone.where("prefix is not null")
    # the first of equal texts, found by partial minima; the others point at it
    same = held.groupBy("d1", "d2").agg(F.min("key").alias("rep"), F.count("*").alias("m"))
    several = same.where("m > 1").drop("m")
    _dealt_join(held.select("key", "d1", "d2"), several, ["d1", "d2"]).select("key", "rep").write.parquet(f"{root}/copies")
    copies = spark.read.parquet(f"{root}/copies")
    reps = held.select("key", "n", "prefix").join(copies.where("key <> rep").select("key"), "key", "left_anti")
    token = reps.select("key", F.explode("prefix").alias("t"))
    least = token.groupBy("t").agg(F.min("key").alias("m"), F.max("key").alias("x")).where("m < x").drop("x")
    near, _ = connected_components(token.join(least, "t").where("key <> m").select(F.col("key").alias("u"), F.col("m").alias("v")), f"{root}/near")
    member = near.union(near.select(F.col("root").alias("node"), "root").distinct())
    sized = held.select("key", "n").join(member, F.col("key") == F.col("node")).select("key", "n", "root")
    parts = sized.groupBy("root").agg(_parts(F.sum("n") / group))
    places = sized.join(parts, "root").select("key", "root", "parts", F.pmod(F.xxhash64("key"), "parts").alias("part"))
    # texts meet their places block by block, so they are shuffled once, to their part
    write_answers(places.withColumn("block", F.shiftright("key", ROW_BITS)), f"{root}/places", partitions_of(blocks))
    dealt = _placed(blocks, f"{root}/places")
    columns = ["root", "part", "key", "words"]
    large = parts.where("parts > 1").limit(1).count() > 0
    if large:
        dealt.write.parquet(f"{root}/dealt")  # so that the texts are read once
        dealt = spark.read.parquet(f"{root}/dealt")
        _large(dealt.where("parts > 1"), everyone, group).write.parquet(f"{root}/large")
        own = spark.read.parquet(f"{root}/large")
        each = F.when(F.col("hub"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array("part"))
        dealt = _spread(dealt.where("parts = 1").select(*columns).union(own.withColumn("part", F.explode(each)).select(*columns)), "root", "part")
    links = dealt.select(*columns).groupBy("root", "part").applyInArrow(frugal_group(_join_group), "u long, v long")
    links.write.parquet(f"{root}/links0")
    links = spark.read.parquet(f"{root}/links0")
    if large:
        _across(own.where("parts > 1").drop("hub"), links, root, group).write.parquet(f"{root}/links1")
        links = links.union(spark.read.parquet(f"{root}/links1"))
    classes, _ = connected_components(links, f"{root}/classes")
    # texts of equal words take the class of their first
    more = copies.where("key <> rep").join(classes, F.col("rep") == F.col("node"), "left").select("key", F.coalesce("root", "rep").alias("class"))
    heads = classes.select("root").union(copies.select("rep")).distinct().select(F.col("root").alias("key"))
    alone = heads.join(classes.select(F.col("node").alias("key")), "key", "left_anti").select("key", F.col("key").alias("class"))
    of = more.union(classes.select(F.col("node").alias("key"), F.col("root").alias("class"))).union(alone)
    return everyone.select("key", "doc_id", "n").join(of, "key", "left")


def _parts(by_size: Column) -> Column:
    """Parts of a component, by its size in parts and by its sets."""
    return F.ceil(F.greatest(by_size, F.count("*") / SETS)).alias("parts")


def _leaders(named: DataFrame, order: Column) -> DataFrame:
    """(class, first): the least ``order`` of each class, by partial minima."""
    return named.where("class is not null").groupBy("class").agg(F.min(order).alias("first"))


def jaccard_classes(docs: DataFrame, block_bytes: int | None = None, group: int = GROUP) -> DataFrame:
    """doc_id, n_shingles, component_id for every document.  The rows are written to the
    shared folder (``release`` deletes them), all else that was written there is deleted."""
    root = work_dir(docs.sparkSession)
    named = _classes(docs, root, block_bytes or block_size(docs), group, False)
    named.write.parquet(f"{root}/named")
    named = docs.sparkSession.read.parquet(f"{root}/named")
    # documents without a class need no partner: only the others meet
    linked = _dealt_join(named.where("class is not null"), _leaders(named, F.col("doc_id")), ["class"])
    out = linked.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id"))
    alone = named.where("class is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    folders = ("blocks", "sets", "copies", "near", "places", "dealt", "large", "links0", "links1", "within", "labelled", "classes", "named")
    return settled_result(out.union(alone), root, *folders)


def _dealt_join(rows: DataFrame, one: DataFrame, on: list[str]) -> DataFrame:
    """Rows (with a ``key``) beside the one row of their group; a group of very many rows is
    dealt over ``SALTS`` keys, to each of which its row goes."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    each = one.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(each, [*on, "salt"]).drop("salt")


def deduplicate(docs: DataFrame, block_bytes: int | None = None, group: int = GROUP) -> DataFrame:
    """One document of each class: the one with the smallest doc_id (ids that are null come
    last; of equal ids one row).  Columns stay, and texts are not shuffled: every block
    finds the rows that it loses beside it.  The result reads folders that ``release``
    deletes once it was written."""
    spark = docs.sparkSession
    root = work_dir(spark)
    named = _classes(docs, root, block_bytes or block_size(docs), group, True).where("class is not null").select("key", "class", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key").alias("order"))
    named.write.parquet(f"{root}/named")
    named = spark.read.parquet(f"{root}/named")
    lost = _dealt_join(named, _leaders(named, F.col("order")), ["class"]).where("order <> first").select(F.shiftright("key", ROW_BITS).alias("block"), F.col("key").bitwiseAND((1 << ROW_BITS) - 1).alias("row"))
    blocks = spark.read.parquet(f"{root}/blocks")
    write_answers(lost, f"{root}/lost", partitions_of(blocks))
    for done in ("sets", "copies", "near", "places", "dealt", "large", "links0", "links1", "within", "labelled", "classes", "named"):
        remove(spark, f"{root}/{done}")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    names = {"doc_id": "doc_id", "text": "text"} | {c: f"x{i}" for i, c in enumerate(others)}
    columns = ["block", "row", *[names[c] for c in docs.columns]]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, gone = None, np.zeros(0, np.int64)
        for block, piece in by_block(batches):
            if block != now:
                now, gone = block, np.array([r["row"] for r in read_answers(f"{root}/lost", block, ["row"])], np.int64)
            mask = ~np.isin(piece.column(1).to_numpy(), gone)
            kept = piece.filter(pa.array(mask))
            yield pa.RecordBatch.from_arrays(kept.columns[2:], names=kept.schema.names[2:])

    flat = blocks.select(*columns)
    schema = StructType(flat.schema.fields[2:])
    out = flat.mapInArrow(frugal(keep), schema)
    return out.select(*[F.col(names[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def _spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Groups over as many tasks as the session has for a shuffle: few bytes of words are
    long work, so partitions that look small stay apart."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, h) of texts (key, root, words): hashes of a set's shingles, others in every component."""
    for batch in batches:
        keys, roots = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        texts = [zlib.decompress(t) for t in batch.column(2).to_pylist()]
        step = np.cumsum([len(t) for t in texts]) // CUT_BYTES
        for cut in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(step)) + 1):
            if len(cut):
                sets = ShingleSets(pa.array([texts[i] for i in cut.tolist()], pa.binary()))
                h = mix(sets.value ^ mix(roots[cut][sets.doc].astype(U64)))
                yield pa.RecordBatch.from_arrays([pa.array(keys[cut][sets.doc]), pa.array(h.view(np.int64))], names=["key", "h"])


def _large(dealt: DataFrame, sizes: DataFrame, group: int) -> DataFrame:
    """The sets of large components that may have a link, dealt into parts anew: (root, key,
    parts, part, hub, words).

    A set of x shingles, of which r occur in other sets of its component, overlaps in r at
    most: it links with sets of y shingles only where ``needed(x, y) <= r``, so y is at most
    ``reach``, and they must reach x.  Sizes are compared in steps, which keeps some more,
    as does a hash that shingles share."""
    each = dealt.select("key", "root", "words").mapInArrow(frugal(_shingles), "key long, h long")
    once = each.groupBy("h").agg(F.min("key").alias("key"), F.max("key").alias("x")).where("key = x").groupBy("key").agg(F.count("*").alias("alone"))
    sets = dealt.select("root", "key").join(sizes.select("key", "n"), "key").join(once, "key", "left").withColumn("shared", F.col("n") - F.coalesce("alone", F.lit(0)))
    sets = sets.select("root", "key", "n", "shared", F.expr(f"{NUM + DEN} * shared div {NUM} - n").alias("reach"))
    steps = sets.groupBy("root", F.floor(F.log2("n") * SIZE_STEPS).alias("step")).agg(F.min("n").alias("least"), F.max("reach").alias("most"))
    steps = steps.groupBy("root").agg(F.collect_list(F.struct("least", "most")).alias("steps"))
    live = _dealt_join(sets, steps, ["root"]).where(F.exists("steps", lambda s: (s["least"] <= F.col("reach")) & (s["most"] >= F.col("n")))).drop("steps", "reach")
    parts = live.groupBy("root").agg(_parts(F.sum("n") / group))
    # the sets with the fewest shingles of their own are the likeliest to be linked
    first = Window.partitionBy("root").orderBy((F.col("n") / F.greatest("shared", F.lit(1))).asc(), "key")
    hubs = live.withColumn("place", F.row_number().over(first)).where(F.col("place") <= HUBS)
    hubs = hubs.withColumn("sum", F.sum("n").over(first.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("sum") <= group // HUB_SHARE).select("key", F.lit(True).alias("hub"))
    places = _dealt_join(live.select("root", "key"), parts, ["root"]).join(hubs, "key", "left")
    places = places.select("root", "key", "parts", F.pmod(F.xxhash64("key"), "parts").alias("part"), F.coalesce("hub", F.lit(False)).alias("hub"))
    return dealt.select("key", "words").join(places, "key")


def _across(dealt: DataFrame, links: DataFrame, root: str, group: int) -> DataFrame:
    """Links between the classes of large components that their parts left: sets outside a
    component's largest class meet all others, both dealt into parts."""
    found, _ = connected_components(links, f"{root}/within")
    labelled = dealt.join(found, dealt["key"] == found["node"], "left").select(dealt["root"], "key", "words", F.coalesce(found["root"], dealt["key"]).alias("label"))
    labelled.write.parquet(f"{root}/labelled")
    labelled = dealt.sparkSession.read.parquet(f"{root}/labelled")
    sizes = labelled.groupBy("root", "label").agg(F.sum(F.length("words")).alias("size"), F.count("*").alias("sets"))
    order = F.struct("size", "label")
    major = sizes.groupBy("root").agg(F.max_by("label", order).alias("major"), F.count("*").alias("classes"), F.sum("size").alias("size"), F.sum("sets").alias("sets"), (F.sum("sets") - F.max_by("sets", order)).alias("others")).where("classes > 1")
    # a part is as many bytes of compressed words as a part of ``group`` shingles has about;
    # more parts, for fewer sets in each, while the sets that meet all of them stay few
    by_sets = F.least(F.ceil(F.col("sets") / SETS), F.ceil(COPIES * F.col("sets") / F.col("others")))
    major = major.select("root", "major", F.greatest(F.ceil(F.col("size") / (2 * group)), by_sets).alias("parts"))
    live = labelled.join(major, "root").withColumn("part", F.pmod(F.xxhash64("key"), "parts"))
    minor = live.where("label <> major")
    weight = minor.groupBy("root").agg(F.ceil(F.sum(F.length("words")) / (2 * group)).alias("minors"))
    minor = minor.join(weight, "root").withColumn("minor", F.pmod(F.xxhash64("key", F.lit(1)), "minors"))
    columns = ["root", "key", "words", "label"]
    # every minor part meets every part, and every other minor part once
    left = minor.select(*columns, F.col("minor").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("b"), F.lit(0).alias("side"))
    right = live.where("label = major").join(weight, "root").select(*columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("minors") - 1)).alias("a"), F.col("part").alias("b"), F.lit(0).alias("side"))
    pair = minor.select(*columns, "minor", F.explode(F.sequence(F.lit(0).cast("long"), F.col("minors") - 1)).alias("other"))
    pair = pair.select(*columns, F.least("minor", "other").alias("a"), F.greatest("minor", "other").alias("b"), F.lit(1).alias("side"))
    both = left.union(right).union(pair)
    return _spread(both, "root", "a", "b", "side").groupBy("root", "a", "b", "side").applyInArrow(frugal_group(_join_group), "u long, v long")
