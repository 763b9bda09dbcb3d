"""Corpora: from Python lists or DataFrames, checked, tokenised by a Column expression or a Python function."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions.tokenizers import text_tokenizer
from quillrank.operators.index import tokenised
from quillrank.sources.shipping import ship

FAILED, NOT_TOKENS = "Tokenizer failed: ", "Failed to extract tokens: "


def of_texts(spark: SparkSession, texts: Sequence[str]) -> DataFrame:
    """(doc_id, text) with positions as ids."""
    _all_strings(texts, "corpus")
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def of_tokens(spark: SparkSession, tokens: Sequence[Sequence[str]]) -> DataFrame:
    """(doc_id, tokens) with positions as ids."""
    for own in tokens:
        _all_strings(own, "tokenized_corpus")
    return spark.createDataFrame([(i, list(own)) for i, own in enumerate(tokens)], "doc_id long, tokens array<string>")


def spread(docs: DataFrame) -> DataFrame:
    """Deals a table out over all cores if its files make fewer partitions than there are cores; larger tables stay."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def by_document(rows: DataFrame) -> DataFrame:
    """Dealt by doc_id, one shuffle when an index is built: what is then computed for (query, document) needs none.

    At least as many partitions as cores; a larger table keeps its number.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(cores, rows.rdd.getNumPartitions()), "doc_id")


def with_dense_ids(texts: DataFrame, order_by: str, text_col: str = "text") -> DataFrame:
    """(doc_id, text) of a table without ids: 0, 1, ... in the order of a column, numbered by partition, not in one task."""
    rows = texts.select(order_by, F.col(text_col).alias("text")).orderBy(order_by)
    return rows.rdd.zipWithIndex().map(lambda x: (x[1], x[0]["text"])).toDF("doc_id long, text string")


def _all_strings(items: object, what: str) -> None:
    if isinstance(items, (str, bytes)) or not isinstance(items, Sequence):
        raise TypeError(f"{what}: a sequence of str is needed, not {type(items).__name__}")
    for x in items:
        if not isinstance(x, str):
            raise TypeError(f"{what}: str is needed, not {type(x).__name__}")


def tokens_of(docs: DataFrame, tokenizer=None) -> DataFrame:
    """(doc_id, tokens) of (doc_id, text). A tokenizer without `column` is a Python function and runs on Arrow batches."""
    if tokenizer is None or hasattr(tokenizer, "column"):
        return tokenised(docs, tokenizer)
    ship(docs.sparkSession)
    return docs.select("doc_id", python_tokenizer(tokenizer)("text").alias("tokens"))


def python_tokenizer(function: Callable[[str], Sequence[str]]):
    """The function as a Column function. Its errors carry the messages that callers see."""

    @F.pandas_udf("array<string>")
    def tokens(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield texts.map(lambda t: _called(function, t))

    return tokens


def _called(function: Callable, text: str) -> list[str]:
    try:
        found = function(text)
    except Exception as e:
        raise ValueError(f"{FAILED}{e}") from e
    if isinstance(found, (str, bytes)) or not isinstance(found, Sequence) or not all(isinstance(t, str) for t in found):
        raise ValueError(f"{NOT_TOKENS}a sequence of str is needed, not {type(found).__name__}")
    return list(found)


def preprocess_corpus(corpus: Sequence[str] | DataFrame, tokenizer=None, **options) -> list[str] | DataFrame:
    """Texts as tokens joined by single blanks. Options are those of tokenize_text, unused with a tokenizer."""
    tokenizer = tokenizer or text_tokenizer(**options)
    if isinstance(corpus, DataFrame):
        return tokens_of(corpus, tokenizer).select("doc_id", F.array_join("tokens", " ").alias("text"))
    return [" ".join(tokenizer(text)) for text in corpus]


def blank_documents(docs: DataFrame) -> DataFrame:
    """doc_id of documents that are null, empty or only white space."""
    blank = F.coalesce(F.col("text"), F.lit("")).rlike(r"^[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*$")
    return docs.where(blank).select("doc_id")


def validate_corpus(corpus: list[str] | DataFrame) -> None:
    """Raises ValueError for what is no usable corpus."""
    if isinstance(corpus, DataFrame):
        if corpus.isEmpty():
            raise ValueError("Corpus cannot be empty")
        first = blank_documents(corpus).agg(F.min("doc_id")).first()[0]
        if first is not None:
            raise ValueError(f"Document at index {first} is empty or contains only whitespace")
        return
    if not isinstance(corpus, list):
        raise ValueError("Corpus must be a list of strings")
    if not corpus:
        raise ValueError("Corpus cannot be empty")
    for i, text in enumerate(corpus):
        if not isinstance(text, str):
            raise ValueError(f"Document at index {i} must be a string, got {type(text)}")
        if not text.strip():
            raise ValueError(f"Document at index {i} is empty or contains only whitespace")


def validate_query(query: list[str]) -> None:
    """Raises ValueError for what is no usable query."""
    if not isinstance(query, list):
        raise ValueError("Query must be a list of strings")
    if not query:
        raise ValueError("Query cannot be empty")
    for i, term in enumerate(query):
        if not isinstance(term, str):
            raise ValueError(f"Query term at index {i} must be a string, got {type(term)}")
