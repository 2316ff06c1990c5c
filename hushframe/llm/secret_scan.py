"""Secret scans over a trigram inverted index (DataFrame functions only).

From each rule's regular expression a Boolean query over lower-case trigrams is
derived: an OR of ANDs that every matching text must satisfy.  The index holds the
postings (trigram, text digest) of exactly the trigrams that some query uses.  Postings
of a text are intersected as bits of a mask: a clause holds where all of its trigrams
do.  Only candidate texts are verified with the rule's expression, in the scan of the
documents, to which the candidates' digests are broadcast if they are few enough; rules
without a mandatory trigram scan every text.

Spans are code-point offsets, end exclusive, from the pieces that lie between the
matches.  Defined results: a null or empty text has no spans; repeated documents give
a row each; documents with null ids are scanned too; an empty table gives no rows.  Very
long texts are whole, and time grows in proportion to their spans.  Columns are found by
place, so clashing names stay as they are.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parse
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared_windows import work_dir
from .textbatch import broadcast_rows, positional, text_key


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose group ``group`` has ``least``
    characters or more.  ``base`` rules come first in the order of kinds."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: The base kinds, in their listed order.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    # a run of 24 or more is the match of [0-9a-f]+ there, as a greedy match takes the whole run
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment_key", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES
MOST_STRINGS, MOST_CLAUSES = 32, 64
Query = frozenset  # of clauses; a clause is a frozenset of trigrams; the empty clause is always true
ALWAYS: Query = frozenset([frozenset()])


def _and(a: Query, b: Query) -> Query:
    if len(a) * len(b) > MOST_CLAUSES:  # a weaker query is still mandatory
        return a if len(a) < len(b) or b == ALWAYS else b
    return _least(frozenset(x | y for x in a for y in b))


def _least(q: Query) -> Query:
    return frozenset(c for c in q if not any(d < c for d in q))


def _of_strings(strings: frozenset[str]) -> Query:
    """All trigrams of one of the strings; a string under three characters says nothing."""
    return _least(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def trigram_query(pattern: str) -> Query:
    """Boolean query that every match of ``pattern`` satisfies, over lower-cased text."""
    exact, query = _walk(sre_parse.parse(pattern))
    return _and(query, _of_strings(exact)) if exact is not None else query


def _walk(nodes) -> tuple[frozenset[str] | None, Query]:
    """Strings that the nodes match exactly (None: too many), and what else must hold."""
    query, run = ALWAYS, frozenset([""])
    closed = True  # whether ``run`` still spans everything so far
    for op, arg in nodes:
        exact, sub = _node(op, arg)
        query = _and(query, sub)
        if exact is not None and len(run) * len(exact) <= MOST_STRINGS:
            run = frozenset(a + b for a in run for b in exact)
        else:
            query = _and(query, _of_strings(run))
            closed = False
            run = exact if exact is not None else frozenset([""])
    if closed:
        return run, query
    return None, _and(query, _of_strings(run))


def _node(op, arg) -> tuple[frozenset[str] | None, Query]:
    if op is sre.LITERAL:
        return frozenset([chr(arg).lower()]), ALWAYS
    if op is sre.IN:
        chars = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                chars.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] - value[0] < 16:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None, ALWAYS
        return (frozenset(chars), ALWAYS) if len(chars) <= 8 else (None, ALWAYS)
    if op is sre.SUBPATTERN:
        return _walk(arg[3])
    if op is sre.BRANCH:
        parts = [_walk(branch) for branch in arg[1]]
        if all(e is not None for e, _ in parts) and sum(len(e) for e, _ in parts) <= MOST_STRINGS:
            return frozenset(s for e, _ in parts for s in e), ALWAYS
        either: Query = frozenset()
        for e, q in parts:
            either |= _and(q, _of_strings(e)) if e is not None else q
        return None, _least(either)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, sub = arg
        exact, query = _walk(sub)
        if exact is not None and high <= 2 and low <= 1 and query == ALWAYS:
            out = frozenset([""]) if low == 0 else frozenset()
            out |= exact
            if high == 2:
                out |= {a + b for a in exact for b in exact}
            return (out, ALWAYS) if len(out) <= MOST_STRINGS else (None, ALWAYS)
        if low == 0:
            return None, ALWAYS
        if exact is not None and low == high and len(exact) ** low <= MOST_STRINGS and low <= 8:
            out = frozenset([""])
            for _ in range(low):
                out = frozenset(a + b for a in out for b in exact)
            return out, query
        return None, _and(query, _of_strings(exact)) if exact is not None else query
    if op is sre.AT:
        return frozenset([""]), ALWAYS
    return None, ALWAYS


def terms_of(rules: tuple[Rule, ...]) -> list[str]:
    """The trigrams that the rules' queries use."""
    return sorted({t for r in rules for c in trigram_query(r.pattern) for t in c})


def build_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Postings (trigram, key) of the trigrams that the rules' queries use; ``key`` is the
    digest of a text, so repeated texts share their postings."""
    terms = terms_of(rules)
    flat, place = positional(docs)
    text = F.col(place["text"])
    low = flat.where(text.isNotNull()).select(text_key(text).alias("key"), F.lower(text).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in terms])) if terms else F.array().cast("array<string>")
    return low.select("key", F.explode(held).alias("trigram"))


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, kinds): the rules whose query the postings satisfy, for each text.

    A trigram is a bit, so postings of a text join to masks before they are shuffled, and
    a clause holds where all its bits do."""
    terms, wide = terms_of(rules), 62
    bit = {t: (i // wide, 1 << (i % wide)) for i, t in enumerate(terms)}
    words = range(-(-len(terms) // wide))
    table = postings.sparkSession.createDataFrame([(t, *bit[t]) for t in terms], "trigram string, word int, bit long")
    masks = postings.join(F.broadcast(table), "trigram").groupBy("key").agg(*[F.coalesce(F.bit_or(F.when(F.col("word") == w, F.col("bit"))), F.lit(0).cast("long")).alias(f"m{w}") for w in words])
    kinds = []
    for r in rules:
        query = trigram_query(r.pattern)
        if query == ALWAYS:
            continue
        either = F.lit(False)
        for clause in sorted(query, key=sorted):
            need = [sum(bit[t][1] for t in clause if bit[t][0] == w) for w in words]
            either = either | reduce(Column.__and__, [F.col(f"m{w}").bitwiseAND(m) == m for w, m in enumerate(need) if m])
        kinds.append(F.when(either, F.lit(r.kind)))
    found = F.array_compact(F.array(*kinds)) if kinds else F.array().cast("array<string>")
    return masks.select("key", found.alias("kinds")).where(F.size("kinds") > 0)


CHUNK = 512
SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _chunks(array: Column) -> Column:
    """An array cut into arrays of ``CHUNK``: aggregates that append copy one at most."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(array), F.lit(1)) - 1) / CHUNK).cast("int")), lambda c: F.slice(array, c * CHUNK + 1, F.lit(CHUNK)))


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, rank, end, kind) of a rule's matches, leftmost first."""
    pattern = F.lit(rule.pattern)
    sized = F.zip_with(
        F.split(text, rule.pattern, -1),
        F.arrays_zip(F.regexp_extract_all(text, pattern, 0).alias("m"), F.regexp_extract_all(text, pattern, rule.group).alias("g")),
        lambda piece, m: F.struct(F.length(piece).alias("gap"), F.length(m["m"]).alias("size"), (F.length(m["g"]) >= rule.least).alias("good")),
    )
    none = F.array().cast(SPANS)
    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def span(begin: Column, end: Column) -> Column:
        return F.struct(begin.alias("start"), F.lit(order).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(x["size"], F.lit(0))
        return F.struct(end.alias("at"), F.when(F.coalesce(x["good"], F.lit(False)), F.concat(acc["out"], F.array(span(begin, end)))).otherwise(acc["out"]).alias("out"))

    def placed(local: Column) -> Column:
        """Spans that each chunk counts from its own start, counted from the text's."""
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        offsets = F.aggregate(local, start, lambda a, x: F.struct((a["at"] + x["at"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
        return F.flatten(F.zip_with(local, offsets, lambda x, o: F.transform(x["out"], lambda s: span(s["start"] + o, s["end"] + o))))

    bound = F.transform(F.array(sized), lambda z: F.transform(_chunks(z), lambda c: F.aggregate(c, zero, step)))
    found = F.element_at(F.transform(bound, placed), 1)
    return F.when(F.regexp_like(text, pattern), found).otherwise(none)


def _with_spans(docs: DataFrame, rules: tuple[Rule, ...]) -> tuple[DataFrame, dict]:
    """The documents, columns renamed by place, with their ``spans``.  Texts stay in the
    scan: candidates come to it as a small table, broadcast if it is small enough."""
    spark = docs.sparkSession
    path = f"{work_dir(spark)}/candidates"
    candidates(build_index(docs, rules), rules).write.parquet(path)
    flat, place = positional(docs)
    source = flat.withColumn("key", text_key(F.col(place["text"]))).join(broadcast_rows(spark.read.parquet(path), 100), "key", "left")
    text = F.coalesce(F.col(place["text"]), F.lit(""))
    parts = []
    for i, rule in enumerate(rules):
        spans = spans_of(text, rule, i)
        full = trigram_query(rule.pattern) == ALWAYS
        parts.append(spans if full else F.when(F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False)), spans).otherwise(F.array().cast(SPANS)))
    return source.withColumn("spans", F.array_sort(F.concat(*parts))), place


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, spans (start, rank, end, kind; in order)."""
    found, place = _with_spans(docs, rules)
    return found.select(F.col(place["doc_id"]).alias("doc_id"), "spans")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span (overlapping ones together) replaced by ``mark``."""
    gaps = "array<struct<a:int,z:int>>"

    def step(acc: Column, s: Column) -> Column:
        gap = F.array(F.struct(acc["at"].alias("a"), s["start"].alias("z")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap)).otherwise(acc["out"]).alias("out"))

    def whole(chunks: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        before = F.aggregate(chunks, start, lambda a, c: F.struct(F.greatest(a["at"], F.array_max(F.transform(c, lambda s: s["end"]))).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
        kept = F.flatten(F.zip_with(chunks, before, lambda c, at: F.aggregate(c, F.struct(at.alias("at"), F.array().cast(gaps).alias("out")), step, lambda a: a["out"])))
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.array_join(F.concat(F.transform(kept, lambda g: F.substr(text, g["a"] + 1, g["z"] - g["a"])), F.array(F.substr(text, last + 1))), mark)

    return F.when(F.size(spans) > 0, F.element_at(F.transform(F.array(_chunks(spans)), whole), 1)).otherwise(text)


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Documents with their secrets replaced; columns, whatever their names, and all other
    documents stay."""
    found, place = _with_spans(docs, rules)
    out = found.withColumn(place["text"], redact(F.col(place["text"]), F.col("spans")))
    return out.select(*[F.col(place[i]).alias(c) for i, c in enumerate(docs.columns)])


def secret_digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, digest of their spans, and all spans as text."""
    found = scan_secrets(docs, rules)

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = [r.kind for r in rules if r.base]

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in base]
    return found.select("doc_id", *counts, F.sha2(listed(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
