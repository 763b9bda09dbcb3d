"""Registered queries of the ranking operators, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions.tokenizers import DefaultTokenizer, RegexTokenizer, SimpleTokenizer, WhitespaceTokenizer, text_tokenizer
from quillrank.functions.weights import VARIANTS, Okapi, Variant
from quillrank.operators import index as ix
from quillrank.operators import ranking
from quillrank.sources.corpus import blank_documents, by_document, preprocess_corpus, spread, tokens_of

#: Fixed values of the registered queries.
QUERY = ("the", "of", "that")
TOP = 10


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


_held: list[ix.Index] = []


def _index(spark: SparkSession, sf_dir: str, tokenizer=None) -> ix.Index:
    """An index that is built once and kept until the next one: a query reads it several times."""
    docs = by_document(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return _kept(ix.build_index(tokens_of(docs, tokenizer), persist=True))


def _kept(index: ix.Index) -> ix.Index:
    while _held:
        _held.pop().unpersist()
    _held.append(index)
    return index.with_mean()


def _benchmark_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, pos, term): the texts of `benchmark` as queries, tokenised as the corpus is."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    tokens = ix.tokenised(items, id_col="item_id")
    return tokens.select(F.col("doc_id").alias("query_id"), F.posexplode("tokens").alias("pos", "term"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def _tokenizer(tokenizer) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: ix.positions(ix.tokenised(_documents(spark, sf_dir), tokenizer))


def _scores(variant: Variant, query: Sequence[str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = _index(spark, sf_dir)
        return _rounded(ranking.scores(index, variant, ranking.prepare(index, variant, query)))

    return run


def _idf(variant: Variant) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _index(spark, sf_dir).weighted(variant).select("term", F.round("idf", 6).alias("idf"))

    return run


def _best(variant: Variant) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = _index(spark, sf_dir)
        prepared = ranking.prepared_table(index, variant, _benchmark_terms(spark, sf_dir))
        return _rounded(ranking.batch_top_n(index, variant, prepared, TOP))

    return run


def _top(variant: Variant, query: Sequence[str], n: int) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = _index(spark, sf_dir)
        return _rounded(ranking.top_n(index, variant, ranking.prepare(index, variant, query), n))

    return run


def preprocessed_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess_corpus(_documents(spark, sf_dir))


def validate_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unusable documents of the table and of some added ones."""
    added = spark.createDataFrame([(-1, ""), (-2, " \t\n"), (-3, None), (-4, "word"), (-5, " 　")], "doc_id long, text string")
    return blank_documents(_documents(spark, sf_dir).unionByName(added))


def doc_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.doc_lengths(ix.tokenised(_documents(spark, sf_dir)))


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.corpus_stats(doc_len(spark, sf_dir)).withColumn("avgdl", F.round("avgdl", 6))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.postings_of(ix.tokenised(_documents(spark, sf_dir))).select("term", "doc_id", "tf")


def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.doc_frequencies(postings(spark, sf_dir))


def preprocess_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known terms of the benchmark texts and of a query with an unknown one."""
    more = spark.createDataFrame([(-1, 0, "the"), (-1, 1, "notaword0"), (-1, 2, "the"), (-1, 3, "The")], "query_id long, pos int, term string")
    found = ranking.prepared_table(_index(spark, sf_dir), VARIANTS["okapi"], _benchmark_terms(spark, sf_dir).unionByName(more))
    return found.withColumn("idf", F.round("idf", 6))


def scores_preprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prepared query for two uses: its scores are those of the query."""
    index, variant = _index(spark, sf_dir), VARIANTS["okapi"]
    prepared = ranking.prepare(index, variant, [*QUERY, "notaword0"])
    assert len(prepared) == len(QUERY)
    return _rounded(ranking.scores(index, variant, prepared))


def tokenized_corpus_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of token arrays that are used as they are, upper case included."""
    tokens = _documents(spark, sf_dir).select("doc_id", F.filter(F.split("text", " ", -1), lambda t: t != "").alias("tokens"))
    index, variant = _kept(ix.build_index(tokens, persist=True)), VARIANTS["plus"]
    return _rounded(ranking.scores(index, variant, ranking.prepare(index, variant, ["The", "the", "of"])))


def custom_tokenizer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python function as the tokenizer: lower-cased words of more than two characters."""
    index, variant = _index(spark, sf_dir, lambda text: [t for t in text.lower().split() if len(t) > 2]), VARIANTS["okapi"]
    return _rounded(ranking.scores(index, variant, ranking.prepare(index, variant, QUERY)))


def batch_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, variant = _index(spark, sf_dir), VARIANTS["okapi"]
    wanted = spark.createDataFrame(list(enumerate([7, 3, 7, 0, 199, 42, 3])), "pos long, doc_id long")
    return _rounded(ranking.scores_of(index, variant, ranking.prepare(index, variant, QUERY), wanted))


def scores_batch_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document for every benchmark text."""
    index, variant = _index(spark, sf_dir), VARIANTS["okapi"]
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"))
    return _rounded(ranking.batch_scores(index, variant, items, ranking.prepared_table(index, variant, _benchmark_terms(spark, sf_dir))))


def batch_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sparse form: documents that share a term with a benchmark text."""
    index, variant = _index(spark, sf_dir), VARIANTS["l"]
    return _rounded(ranking.batch_candidates(index, variant, ranking.prepared_table(index, variant, _benchmark_terms(spark, sf_dir))))


def top_n_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What get_top_n_indices returns in the driver: candidates and then fillers."""
    index, variant = _index(spark, sf_dir), VARIANTS["okapi"]
    best = ranking.top_n_rows(index, variant, ranking.prepare(index, variant, ("9541066823582205", "notaword0")), 20)
    return _rounded(spark.createDataFrame([(k, i, x) for k, (i, x) in enumerate(best, 1)], "rank int, doc_id long, score double"))


def top_n_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, variant = _index(spark, sf_dir), VARIANTS["okapi"]
    ranked = ranking.top_n(index, variant, ranking.prepare(index, variant, QUERY), 5)
    return _rounded(ranking.with_text(ranked, _documents(spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    okapi = VARIANTS["okapi"]
    found = {
        "tokenize_default": _tokenizer(DefaultTokenizer()),
        "tokenize_simple": _tokenizer(text_tokenizer()),
        "tokenize_simple_stop": _tokenizer(SimpleTokenizer(remove_stopwords=True)),
        "tokenize_whitespace": _tokenizer(WhitespaceTokenizer(lowercase=False)),
        "tokenize_regex": _tokenizer(RegexTokenizer()),
        "preprocess_corpus": preprocessed_corpus,
        "scores_duplicate_terms": _scores(okapi, ("that", "the", "that")),
        "scores_custom_params": _scores(Okapi(k1=2.0, b=0.5, epsilon=0.1), QUERY),
        "scores_oov": _scores(okapi, ("notaword0", "notaword1")),
        "scores_case_sensitive": _scores(okapi, ("The", "that")),
        "scores_chunked": _scores(okapi, QUERY),
        "top_n_filler": _top(okapi, ("9541066823582205", "notaword0"), 20),
        "top_n_oov": _top(okapi, ("notaword0",), 7),
        "top_n_negative": _top(Okapi(epsilon=-0.25), ("the",), 600),
    }
    for name, variant in VARIANTS.items():
        found |= {f"idf_{name}": _idf(variant), f"scores_{name}": _scores(variant, QUERY), f"top_n_indices_{name}": _best(variant)}
    own = (
        validate_corpus, doc_len, corpus_stats, postings, doc_freq, preprocess_query, scores_preprocessed, tokenized_corpus_scores,
        custom_tokenizer_scores, batch_scores, scores_batch_queries, batch_candidates, top_n_rows, top_n_text,
    )
    return found | {f.__name__: f for f in own}
