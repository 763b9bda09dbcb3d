"""DuckDB SQL for the registered ranking queries. Counts are BIGINT, numbers DOUBLE, sums in the order of the query."""

from __future__ import annotations

from quillrank.functions.tokenizers import STOPWORDS
from quillrank.functions.weights import VARIANTS, Long, Okapi, Plus, Variant

_WORDS = "list_filter(string_split_regex(lower(text), '\\s+'), lambda t: t <> '')"
_SIMPLE = "list_filter(string_split_regex(regexp_replace(lower(text), '[!-/:-@\\[-`{-~]', '', 'g'), '\\s+'), lambda t: t <> '')"


def _tokens(expression: str) -> str:
    return f"SELECT doc_id, unnest(generate_series(0, len(t) - 1))::INTEGER AS pos, unnest(t) AS term FROM (SELECT doc_id, {expression} AS t FROM documents) WHERE len(t) > 0"


def _index(expression: str = _WORDS) -> str:
    return f"""
tok AS (SELECT doc_id, {expression} AS t FROM documents),
dl AS (SELECT doc_id, len(t)::BIGINT AS dl FROM tok),
st AS (SELECT count(*)::DOUBLE AS n, sum(dl)::DOUBLE / count(*)::DOUBLE AS avgdl FROM dl),
post AS (SELECT term, doc_id, count(*)::DOUBLE AS tf, max(dl)::DOUBLE AS dl
         FROM (SELECT doc_id, len(t)::BIGINT AS dl, unnest(t) AS term FROM tok) GROUP BY term, doc_id),
trm AS (SELECT term, count(*)::BIGINT AS df FROM post GROUP BY term)"""


def _lit(x: float) -> str:
    return f"{x!r}::DOUBLE"


def _idf(variant: Variant) -> str:
    """Adds idf (term, df, idf)."""
    if isinstance(variant, Okapi):
        raw = "ln((n - df::DOUBLE + 0.5::DOUBLE) / (df::DOUBLE + 0.5::DOUBLE))"
        return f""",
hist AS (SELECT df, count(*)::DOUBLE AS c FROM trm GROUP BY df),
mean AS (SELECT sum(c * {raw} ORDER BY df) / sum(c) AS mean FROM hist, st),
idf AS (SELECT term, df, CASE WHEN {raw} < 0 THEN {_lit(variant.epsilon)} * mean ELSE {raw} END AS idf FROM trm, st, mean)"""
    shift = " + 0.5::DOUBLE" if isinstance(variant, Long) else ""
    return f""",
idf AS (SELECT term, df, ln(n + 1) - ln(df::DOUBLE{shift}) AS idf FROM trm, st)"""


def _term(variant: Variant) -> str:
    k1, length = _lit(variant.k1), f"({_lit(1 - variant.b)} + {_lit(variant.b)} / avgdl * dl)"
    up = f"tf * {_lit(variant.k1 + 1)}"
    if isinstance(variant, Okapi):
        return f"idf * (({up}) / (tf + {k1} * {length}))"
    if isinstance(variant, Plus):
        return f"idf * (({_lit(variant.delta)} + {up}) / ({k1} * {length} + tf))"
    c = f"(CASE WHEN {length} > 0 THEN tf / {length} ELSE 0 END)"
    return f"(idf * ({_lit(variant.k1 + 1)} * ({c} + {_lit(variant.delta)}))) / ({k1} + {c} + {_lit(variant.delta)})"


def _query(terms: tuple[str, ...]) -> str:
    rows = ", ".join(f"(0, {i}, '{t}')" for i, t in enumerate(terms))
    return f",\nq(query_id, pos, term) AS (VALUES {rows})"


_BENCH = f""",
q AS (SELECT item_id AS query_id, unnest(generate_series(0, len(t) - 1))::INTEGER AS pos, unnest(t) AS term
      FROM (SELECT item_id, {_WORDS} AS t FROM benchmark) WHERE len(t) > 0)"""


def _hits(variant: Variant) -> str:
    """Adds hit (query_id, doc_id, score)."""
    return f""",
hit AS (SELECT query_id, doc_id, sum({_term(variant)} ORDER BY pos) AS score
        FROM q JOIN idf USING (term) JOIN post USING (term), st GROUP BY query_id, doc_id)"""


def _with(variant: Variant, query: str, words: str = _WORDS) -> str:
    return f"WITH {_index(words)}{_idf(variant)}{query}{_hits(variant)}\n"


def _scores(variant: Variant, terms: tuple[str, ...], words: str = _WORDS) -> str:
    return _with(variant, _query(terms), words) + "SELECT doc_id, round(coalesce(score, 0), 6) AS score FROM dl LEFT JOIN hit USING (doc_id)"


def _best(variant: Variant) -> str:
    return _with(variant, _BENCH) + """SELECT query_id, rank::INTEGER AS rank, doc_id, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hit) WHERE rank <= 10"""


def _top(variant: Variant, terms: tuple[str, ...], n: int, columns: str = "rank::INTEGER AS rank, doc_id, round(score, 6) AS score", more: str = "") -> str:
    return _with(variant, _query(terms)) + f"""SELECT {columns} FROM (
SELECT doc_id, coalesce(score, 0) AS score, row_number() OVER (ORDER BY score IS NOT NULL DESC, score DESC NULLS LAST, doc_id) AS rank
FROM dl LEFT JOIN hit USING (doc_id)) {more} WHERE rank <= {n}"""


def oracle_sql() -> dict[str, str]:
    okapi, three = VARIANTS["okapi"], ("the", "of", "that")
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    found = {
        "tokenize_default": _tokens(_WORDS),
        "tokenize_simple": _tokens(_SIMPLE),
        "tokenize_simple_stop": _tokens(f"list_filter({_SIMPLE}, lambda t: t NOT IN ({stop}))"),
        "tokenize_whitespace": _tokens("list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '')"),
        "tokenize_regex": _tokens("list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda t: lower(t))"),
        "preprocess_corpus": f"SELECT doc_id, array_to_string({_SIMPLE}, ' ') AS text FROM documents",
        "validate_corpus": "SELECT doc_id FROM (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES (-1, ''), (-2, chr(9)), (-3, NULL), (-4, 'word'), (-5, ' '))) WHERE trim(coalesce(text, ''), chr(9) || chr(10) || chr(13) || ' ') = ''",
        "doc_len": f"SELECT doc_id, len({_WORDS})::INTEGER AS dl FROM documents",
        "corpus_stats": f"SELECT count(*)::BIGINT AS n, sum(dl)::BIGINT AS total_len, round(sum(dl)::DOUBLE / count(*)::DOUBLE, 6) AS avgdl FROM (SELECT len({_WORDS}) AS dl FROM documents)",
        "postings": f"WITH {_index()} SELECT term, doc_id, tf::INTEGER AS tf FROM post",
        "doc_freq": f"WITH {_index()} SELECT term, df FROM trm",
        "preprocess_query": f"WITH {_index()}{_idf(okapi)}{_BENCH} SELECT query_id, pos::INTEGER AS pos, term, round(idf, 6) AS idf FROM (SELECT query_id, pos, term FROM q UNION ALL SELECT * FROM (VALUES (-1, 0, 'the'), (-1, 1, 'notaword0'), (-1, 2, 'the'), (-1, 3, 'The'))) JOIN idf USING (term)",
        "scores_duplicate_terms": _scores(okapi, ("that", "the", "that")),
        "scores_custom_params": _scores(Okapi(k1=2.0, b=0.5, epsilon=0.1), three),
        "scores_oov": _scores(okapi, ("notaword0", "notaword1")),
        "scores_case_sensitive": _scores(okapi, ("The", "that")),
        "scores_chunked": _scores(okapi, three),
        "scores_preprocessed": _scores(okapi, three),
        "tokenized_corpus_scores": _scores(VARIANTS["plus"], ("The", "the", "of"), "list_filter(string_split(text, ' '), lambda t: t <> '')"),
        "custom_tokenizer_scores": _scores(okapi, three, f"list_filter({_WORDS}, lambda t: length(t) > 2)"),
        "batch_scores": _with(okapi, _query(three)) + "SELECT pos::BIGINT AS pos, doc_id::BIGINT AS doc_id, round(coalesce(score, 0), 6) AS score FROM (VALUES (0, 7), (1, 3), (2, 7), (3, 0), (4, 199), (5, 42), (6, 3)) w(pos, doc_id) LEFT JOIN hit USING (doc_id)",
        "scores_batch_queries": _with(okapi, _BENCH) + "SELECT item_id AS query_id, dl.doc_id, round(coalesce(score, 0), 6) AS score FROM benchmark CROSS JOIN dl LEFT JOIN hit ON hit.query_id = item_id AND hit.doc_id = dl.doc_id",
        "batch_candidates": _with(VARIANTS["l"], _BENCH) + "SELECT query_id, doc_id, round(score, 6) AS score FROM hit",
        "top_n_text": _top(okapi, three, 5, "rank::INTEGER AS rank, text, round(score, 6) AS score", "JOIN documents USING (doc_id)"),
        "top_n_filler": _top(okapi, ("9541066823582205", "notaword0"), 20),
        "top_n_rows": _top(okapi, ("9541066823582205", "notaword0"), 20),
        "top_n_oov": _top(okapi, ("notaword0",), 7),
        "top_n_negative": _top(Okapi(epsilon=-0.25), ("the",), 600),
    }
    for name, variant in VARIANTS.items():
        found |= {
            f"idf_{name}": f"WITH {_index()}{_idf(variant)} SELECT term, round(idf, 6) AS idf FROM idf",
            f"scores_{name}": _scores(variant, three),
            f"top_n_indices_{name}": _best(variant),
        }
    return found
