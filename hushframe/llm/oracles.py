"""SQL (DuckDB) of the subpackage's queries that SQL can express, over whole tables."""

from __future__ import annotations

from .secret_scan import RULES

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Windows of 50 bytes; runs of removed bytes; what is left between them.
OP2 = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, s, b[s + 1 : s + 50] AS g FROM (SELECT doc_id, b, unnest(range(0, n - 49)) AS s FROM d WHERE n >= 50)),
f AS (SELECT g, min(doc_id) AS first FROM w GROUP BY g),
h AS (SELECT w.doc_id, s FROM w JOIN f USING (g) WHERE w.doc_id > first),
i AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 50 THEN 0 ELSE 1 END AS new FROM h),
j AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM i),
r AS (SELECT doc_id, run, min(s) AS a, max(s) + 50 AS z FROM j GROUP BY doc_id, run),
k AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS following FROM r),
p AS (SELECT k.doc_id, string_agg(hex(b[before + 1 : a]) || CASE WHEN following IS NULL THEN hex(b[z + 1 : n]) ELSE '' END, '' ORDER BY a) AS kept, sum(z - a) AS removed, count(*) AS spans FROM k JOIN d USING (doc_id) GROUP BY k.doc_id)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(coalesce(unhex(kept), b)) AS kept_sha256 FROM d LEFT JOIN p USING (doc_id)
"""

#: Base 32 of a sha1: four groups of ten hexadecimal digits make eight characters each.
OP4 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (h)
"""

#: Pairs that share a shingle, their overlap, and the closure of the links.
OP5 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) AS g FROM w WHERE len(ws) >= 5
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce((SELECT min(y) FROM r WHERE x = doc_id), doc_id)) AS component_id FROM documents LEFT JOIN n USING (doc_id)
"""

#: Windows of 20 words that start earlier elsewhere; the words that no such window covers.
OP6 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
g AS (SELECT doc_id, s, array_to_string(ws[s : s + 19], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20)),
h AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS k FROM g) WHERE k > 1),
c AS (SELECT DISTINCT doc_id, s + unnest(range(20)) AS i FROM h),
k AS (SELECT doc_id, i, x FROM (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w) ANTI JOIN c USING (doc_id, i)),
t AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS kept FROM k GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN t USING (doc_id)
"""

_TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP9 = f"""
WITH b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_TERM}') AS ws FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS ws FROM documents),
z AS (SELECT DISTINCT n FROM g),
p AS (SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, z WHERE len(ws) >= n)),
h AS (SELECT p.doc_id, p.i, p.n, g.item_id FROM p JOIN g ON p.g = g.g AND p.n = g.n),
c AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, i + unnest(range(n)) AS place FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def _rule(i: int) -> str:
    """Spans of one rule: a match begins where the pieces and matches before it end."""
    rule = RULES[i]
    pattern = rule.pattern.replace("'", "''")
    return f"""
SELECT doc_id, {i} AS rank, '{rule.kind}' AS kind, a, a + m AS z FROM (
  SELECT doc_id, m, g, sum(gap) OVER w + coalesce(sum(m) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM (
    SELECT doc_id, unnest(range(len(ms))) AS i, unnest(list_transform(ms, lambda x: length(x))) AS m, unnest(list_transform(gs, lambda x: length(x))) AS g,
      unnest(list_transform(ps[1 : len(ms)], lambda x: length(x))) AS gap
    FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS ms, regexp_extract_all(t, '{pattern}', {rule.group}) AS gs, string_split_regex(t, '{pattern}') AS ps FROM d) WHERE len(ms) > 0)
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE g >= {rule.least}"""


_BASE = [r.kind for r in RULES if r.base]
_LISTED = "string_agg(kind || ':' || a::BIGINT || ':' || z::BIGINT, ',' ORDER BY a, rank)"
OP10 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_rule(i) for i in range(len(RULES)))}),
t AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _BASE)}, {_LISTED} FILTER (rank < {len(_BASE)}) AS base, {_LISTED} AS spans FROM s GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in _BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN t USING (doc_id)
"""

#: Crc32 bit by bit; planted words; for each distance the stretches in which words agree
#: with those so far on, and of one stretch of words its smallest distance; words left.
OP12 = f"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws,
  xor(list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])), lambda x, y: xor(xor(x, y) >> 1, (xor(x, y) & 1) * 3988292384), 4294967295::BIGINT), 4294967295) AS h FROM documents),
g AS (SELECT doc_id, ws, h, len(ws) AS n, h // 10 AS g FROM t),
a AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM g),
p AS (SELECT *, CASE WHEN n > 0 THEN 1 + (n - a) // (3 + g % 8) END AS p FROM a),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_concat(ws[1 : a], list_transform(range(0, n - a), lambda i: ws[1 + a + i % p])) ELSE ws END AS ws FROM p),
w AS (SELECT doc_id, n, unnest(ws) AS x, unnest(range(n)) AS i FROM d),
e AS (SELECT l.doc_id, l.i, r.i - l.i AS q FROM w l JOIN w r ON l.doc_id = r.doc_id AND l.x = r.x AND r.i > l.i WHERE 4 * (r.i - l.i) <= l.n),
f AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS f FROM e),
s AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS m FROM f GROUP BY doc_id, q, f HAVING count(*) >= 3 * q AND count(*) + q >= 6),
r AS (SELECT doc_id, s, m, min(q) AS q FROM s GROUP BY doc_id, s, m),
c AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + m)) AS i FROM r),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM w ANTI JOIN c USING (doc_id, i) GROUP BY doc_id),
o AS (SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(s, m, q), (-m, s, q)) AS top, string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q) AS told FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top.s::BIGINT AS start, top.m::BIGINT AS length, top.q::BIGINT AS period, (1000 * top.m // top.q)::BIGINT AS exponent_milli,
  sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN o USING (doc_id) LEFT JOIN k USING (doc_id)
"""

ORACLE_SQL = {
    "op2_suffix_array_dedup": OP2,
    "op4_warc_index": OP4,
    "op5_jaccard_trie": OP5,
    "op6_suffix_tree_dedup": OP6,
    "op9_decontaminate": OP9,
    "op10_secret_trigrams": OP10,
    "op12_periodic_runs": OP12,
}
