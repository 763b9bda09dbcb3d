"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_SQUEEZED = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"

OP2 = f"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, {_SQUEEZED} AS body FROM documents),
g AS (SELECT doc_id, body, first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g
"""

OP10 = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last_id FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id < c.last_id, false) AS lost FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


OP7 = r"""
WITH r(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
             row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS nth
      FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE nth = 1
"""


#: Windows of 100 bytes as hex; a window goes if it is not the first with its bytes, a byte if such a window covers it.
OP1 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS p FROM d WHERE length(h) >= 200)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1 AS gone FROM w),
b AS (SELECT doc_id, p, max(CASE WHEN gone THEN p END) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) IS NOT NULL AS removed
      FROM (SELECT doc_id, unnest(range(0, length(h) // 2)) AS p FROM d) LEFT JOIN r USING (doc_id, p)),
s AS (SELECT doc_id, p, removed, removed AND NOT coalesce(lag(removed) OVER (PARTITION BY doc_id ORDER BY p), false) AS first FROM b),
t AS (SELECT doc_id, count(*) FILTER (removed) AS n_removed, count(*) FILTER (first) AS n_spans,
             string_agg(substr(h, 2 * p + 1, 2), '' ORDER BY p) FILTER (NOT removed) AS kept FROM s JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""

OP6 = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM t),
e AS (SELECT doc_id, len(g)::BIGINT AS n, unnest(g) AS x FROM s),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n_common, any_value(a.n) AS m, any_value(b.n) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM c WHERE 100 * n_common >= 75 * (m + n - n_common)),
k AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, k.v FROM reach JOIN k ON reach.b = k.u)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, min(reach.b) AS component_id FROM s JOIN reach ON reach.a = s.doc_id GROUP BY s.doc_id, len(g)
"""


def _any_case(words: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


def _secrets() -> str:
    """A kind's matches and the pieces between them, each in one pass; a match starts behind all pieces and matches before it."""
    begin, end = ("-----%s [A-Z ]*PRIVATE KEY(?: BLOCK)?-----" % x for x in ("BEGIN", "END"))
    tail = r"(?:\r?\n[A-Za-z][A-Za-z-]*: [^\n]*)*(?:[ \t\r\n]*[A-Za-z0-9+/=]{16,})*"
    assign = f"(?:{_any_case('password|passwd|secret|token|api_?key')})" + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    kinds = [
        ("assign", assign, f"length(regexp_extract(hit, '{assign}', 1)) >= 6", "0"),
        ("access", "AKIA[A-Z0-9]+", "length(hit) >= 20", "0"),
        ("hex", "[0-9a-f]+", "length(hit) >= 24", "0"),
        ("pem", f"{begin}(?:(?:[^-]|-{{1,4}}[^-])*{end}|{tail})", "true", "0"),
        # the character before the first part is taken along, as there is no looking back
        ("jwt", r"(?:^|[^A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "true", "CASE WHEN starts_with(hit, 'eyJ') THEN 0 ELSE 1 END"),
    ]
    parts = [
        f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, stop - length(hit) + {lead} AS start, stop FROM (
SELECT doc_id, hit, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY nth)::BIGINT AS stop FROM (
SELECT doc_id, unnest(hits) AS hit, unnest(gaps[:len(hits)]) AS gap, generate_subscripts(hits, 1) AS nth FROM (
SELECT doc_id, regexp_extract_all(text, '{pattern}') AS hits, string_split_regex(text, '{pattern}') AS gaps FROM documents WHERE regexp_matches(text, '{pattern}')))) WHERE {keep}"""
        for rank, (kind, pattern, keep, lead) in enumerate(kinds)
    ]
    line = "kind || ':' || start || ':' || stop"
    return f"""
WITH f AS ({' UNION ALL '.join(parts)}),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg({line}, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg({line}, ',' ORDER BY start, rank) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN g USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_dedup": OP1, "op2_exact_dedup": OP2, "op6_ngram_jaccard": OP6, "op7_url_filter": OP7, "op9_secret_scan": _secrets(),
        "op10_line_dedup": OP10,
    }
