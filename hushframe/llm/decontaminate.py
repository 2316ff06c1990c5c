"""Benchmark decontamination by a broadcast hash set of test n-grams (DataFrame functions only).

Benchmark items are normalised (A-Z lower-cased, words of letters, digits and
non-ASCII characters) and cut into windows of ``n`` words; a shorter item is one
window.  The hashes of all windows are set in a bit array, sized by their counted number,
that travels with the scan: every window of a document that can be a test window passes
it, and only those leave the scan, with their words, which are compared with the test
windows' words.  So no text travels at any size of the benchmark; where the bit array
fills up (``MOST_BITS``), more windows travel to be compared, with the same rows.

Defined results: null or empty texts have no words and are clean; items without
words never hit; items with a null id mark words but are not counted; repeated
documents give a row each; an empty benchmark leaves everything clean, an empty table
has no rows.  Very long texts are whole.  Columns are found by place, so clashing names stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared_windows import work_dir
from .textbatch import broadcast_rows, pick, positional, text_key

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The bit array has some 32 bits for each window, at most 8 MB.
BITS_EACH, MOST_BITS = 32, 1 << 26
PLACES = "array<struct<pos:int,size:int,gram:array<string>>>"


def normal_words(text: Column) -> Column:
    """Lower-cased words in order; null gives none."""
    text = F.coalesce(text, F.lit(""))
    # lower() is the fast way where there are no letters but A-Z that it could change
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    # an empty string can only be where a text begins or ends with a separator
    return F.array_remove(F.split(low, NOT_WORD), "")


def benchmark_windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """(item_id, size, gram): the distinct windows of each item."""
    words = pick(benchmark, "item_id", "text").select("item_id", normal_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    sized = words.withColumn("size", F.least(F.size("w"), F.lit(n)))
    at = F.explode(F.expr("transform(sequence(1, size(w) - size + 1), i -> slice(w, i, size))"))
    return sized.select("item_id", "size", at.alias("gram")).distinct()


class HashSet:
    """Sizes of the windows, and a bit array of the hashes of windows and of their first two
    words, as a literal of the scan's expression."""

    def __init__(self, windows: DataFrame):
        marks = windows.select("size", F.explode(F.array(self._whole(F.col("gram")), self._outer(F.col("gram"), F.lit(1), F.col("size")))).alias("h"))
        counted = {r["size"]: r["m"] for r in windows.groupBy("size").agg(F.count("*").alias("m")).collect()}
        self.sizes, total = sorted(counted), sum(counted.values())
        self.bits = min(MOST_BITS, 1 << max(10, math.ceil(math.log2(max(1, BITS_EACH * total)))))
        at = F.col("h").bitwiseAND(self.bits - 1)
        words = marks.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast(h & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit"))
        array = [0] * (self.bits >> 6)
        for r in words.collect():  # at most MOST_BITS / 64 rows
            array[r["word"]] = r["bit"]
        self.array = F.split(F.lit(",".join(map(str, array))), ",").cast("array<bigint>")  # folded to one literal

    @staticmethod
    def _whole(gram: Column) -> Column:
        return F.xxhash64(gram)

    @staticmethod
    def _outer(words: Column, i: Column, size: Column) -> Column:
        """Hash of the first two words of a window at ``i``, of the one where it is one word."""
        first = F.get(words, i - 1)
        return F.when(size > 1, F.xxhash64(first, F.get(words, i))).otherwise(F.xxhash64(first))

    def holds(self, h: Column) -> Column:
        at = h.bitwiseAND(self.bits - 1)
        return F.getbit(F.get(self.array, F.shiftright(at, 6).cast("int")), at.bitwiseAND(63).cast("int")) == 1

    def places(self, w: Column) -> Column:
        """Windows of the words ``w`` that may be test windows: places whose first words may
        begin one are found in one pass for all sizes, then each size is tested there."""
        none, nowhere = F.array().cast(PLACES), F.array().cast("array<int>")
        found = []
        for few, sizes in ((1, [s for s in self.sizes if s == 1]), (2, [s for s in self.sizes if s > 1])):
            if sizes:
                begins = F.when(F.size(w) >= few, self._begins(w, few)).otherwise(nowhere)
                found.append(self._tested(w, begins, sizes))
        return F.concat(*found) if found else none

    def _tested(self, w: Column, begins: Column, sizes: list[int]) -> Column:
        return F.element_at(F.transform(F.array(begins), lambda at: F.concat(*[self._of_size(w, at, size) for size in sizes])), 1)

    def _begins(self, w: Column, few: int) -> Column:
        return F.filter(F.sequence(F.lit(1), F.size(w) - (few - 1)), lambda i: self.holds(self._outer(w, i, F.lit(few))))

    def _of_size(self, w: Column, begins: Column, size: int) -> Column:
        at = F.filter(begins, lambda i: (i <= F.size(w) - (size - 1)) & self.holds(self._whole(F.slice(w, i, F.lit(size)))))
        return F.transform(at, lambda i: F.struct(i.alias("pos"), F.lit(size).alias("size"), F.slice(w, i, F.lit(size)).alias("gram")))


def _scanned(text: Column, known: HashSet) -> Column:
    """(n_words, places) of a text, whose words are cut once: they are bound as the
    variable of a lambda."""
    bound = F.transform(F.array(normal_words(text)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), known.places(w).alias("places")))
    return F.element_at(bound, 1)


def _grams(windows: DataFrame) -> DataFrame:
    """The test windows with their items, broadcast if they are few enough."""
    grams = windows.groupBy("size", "gram").agg(F.collect_set("item_id").alias("item_ids"))
    return broadcast_rows(grams, 200)


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted strings), hits (pos, size)."""
    windows = benchmark_windows(benchmark, n)
    base = pick(docs, "doc_id", "text").select("doc_id", F.monotonically_increasing_id().alias("rid"), _scanned(F.col("text"), HashSet(windows)).alias("s"))
    hit = base.select("rid", "doc_id", "s.n_words", F.explode_outer("s.places").alias("p")).select("rid", "doc_id", "n_words", "p.pos", "p.size", "p.gram")
    joined = hit.join(_grams(windows), ["size", "gram"], "left")
    real = F.col("item_ids").isNotNull()
    grouped = joined.groupBy("rid").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "n_words")],
        F.sort_array(F.collect_set(F.when(real, F.struct("pos", "size")))).alias("hits"),
        F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("ids"),
    )
    covered = F.expr(
        "aggregate(hits, named_struct('e', 0, 'c', 0L), (a, x) -> named_struct("
        "'e', greatest(a.e, x.pos + x.size), 'c', a.c + greatest(0, x.pos + x.size - greatest(a.e, x.pos))), a -> a.c)"
    )
    items = F.sort_array(F.transform("ids", lambda x: x.cast("string")))
    return grouped.select("doc_id", "n_words", covered.alias("n_hit"), F.size("ids").cast("long").alias("n_items"), items.alias("items"), "hits")


def clean_text(text: Column, hits: Column) -> Column:
    """The text without the words that lie in hit windows; separators stay."""
    separators = F.split(text, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    words = F.filter(F.split(text, NOT_WORD_ANY_CASE), lambda x: x != "")
    kept = F.transform(words, lambda x, i: F.when(F.exists(hits, lambda h: (i >= h["pos"] - 1) & (i < h["pos"] - 1 + h["size"])), F.lit("")).otherwise(x))
    joined = F.array_join(F.zip_with(separators, kept, lambda s, x: F.concat(s, F.coalesce(x, F.lit("")))), "")
    return F.when(F.size(hits) > 0, joined).otherwise(text)


def decontaminate(docs: DataFrame, benchmark: DataFrame, how: str = "documents", n: int = 10) -> DataFrame:
    """Documents without contamination: ``how`` removes hit ``documents`` or only the
    hit ``spans`` of their texts.  Columns of ``docs`` stay.

    Hits are found by text (its digest), so repeated texts are verified together, and
    come back to the scan as a small table, which is broadcast if it is small enough."""
    if how not in ("documents", "spans"):
        raise ValueError("how must be 'documents' or 'spans'")
    spark, windows = docs.sparkSession, benchmark_windows(benchmark, n)
    flat, place = positional(docs)
    text = F.col(place["text"])
    base = flat.where(text.isNotNull()).select(text_key(text).alias("key"), _scanned(text, HashSet(windows)).alias("s"))
    hit = base.select("key", F.explode("s.places").alias("p")).select("key", "p.pos", "p.size", "p.gram")
    real = hit.join(_grams(windows), ["size", "gram"])
    path = f"{work_dir(spark)}/found"
    hits = F.sort_array(F.collect_set(F.struct("pos", "size")))
    (real.select("key").distinct() if how == "documents" else real.groupBy("key").agg(hits.alias("hits"))).write.parquet(path)
    found = broadcast_rows(spark.read.parquet(path), 64 if how == "documents" else 1000)
    keyed = flat.withColumn("key", text_key(text))
    if how == "documents":
        kept = keyed.join(found, "key", "left_anti")
    else:
        kept = keyed.join(found, "key", "left").withColumn(place["text"], F.when(F.col("hits").isNull(), text).otherwise(clean_text(text, F.col("hits"))))
    return kept.select(*[F.col(place[i]).alias(c) for i, c in enumerate(docs.columns)])


def contamination_digest(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The digest columns of a contamination report."""
    found = find_contamination(docs, benchmark, n)
    sha = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", sha.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
