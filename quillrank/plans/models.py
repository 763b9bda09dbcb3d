"""Ranking models over a corpus: build once, then score, rank, and batch. Lists and DataFrames both work."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions.weights import Long, Okapi, Plus, Variant
from quillrank.operators import ranking
from quillrank.operators.index import Index, build_index, load_index, save_index
from quillrank.sources.corpus import FAILED, NOT_TOKENS, by_document, of_texts, of_tokens, tokens_of


#: Terms whose weights a model remembers.
MOST_REMEMBERED = 50_000


@dataclass(frozen=True)
class PreprocessedQuery:
    """A query's known terms with their weights in one model; to be used with that model only."""

    prepared: ranking.PreparedQuery

    def __len__(self) -> int:
        return len(self.prepared)


#: The name under which other programs know it.
PyPreprocessedQuery = PreprocessedQuery


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def _query(query: Sequence[str]) -> list[str]:
    if isinstance(query, (str, bytes)) or not isinstance(query, Sequence):
        raise TypeError(f"A query is a sequence of str, not {type(query).__name__}")
    for term in query:
        if not isinstance(term, str):
            raise TypeError(f"A query's terms are str, not {type(term).__name__}")
    return list(query)


def _count(n: int | None, default: int = 5) -> int:
    if n is None:
        return default
    if n < 0:
        raise OverflowError("can't convert negative int to unsigned")
    return n


class Model:
    """Common to the variants. doc_id is the position in a list, or the column doc_id of a DataFrame."""

    variant_type: type[Variant]

    def __init__(self, variant: Variant, corpus, tokenizer, tokenized_corpus, spark: SparkSession | None):
        if corpus is not None and tokenized_corpus is not None:
            raise ValueError("Provide either corpus or tokenized_corpus, not both.")
        if corpus is None and tokenized_corpus is None:
            raise ValueError("Either corpus or tokenized_corpus must be provided.")
        given = corpus if corpus is not None else tokenized_corpus
        self.variant, self.tokenizer, self.dense = variant, tokenizer, not isinstance(given, DataFrame)
        self.spark = given.sparkSession if isinstance(given, DataFrame) else spark or _session()
        self._weights: dict[str, float | None] = {}
        self.index = self._built(self._tokens(corpus, tokenized_corpus))
        if not self.index.n:
            self.index.unpersist()
            raise ValueError("Corpus size must be greater than zero.")

    def _tokens(self, corpus, tokenized_corpus) -> DataFrame:
        if corpus is None:
            return by_document(tokenized_corpus if isinstance(tokenized_corpus, DataFrame) else of_tokens(self.spark, tokenized_corpus))
        if not isinstance(corpus, DataFrame):
            corpus = of_texts(self.spark, corpus)
        elif not corpus.where(F.col("text").isNull()).isEmpty():
            raise ValueError("Documents must not be null.")
        return tokens_of(by_document(corpus), self.tokenizer)

    def _built(self, tokens: DataFrame) -> Index:
        """Built at once, so that a tokenizer's errors come from the constructor."""
        try:
            index = build_index(tokens, persist=True)
            return index.with_mean() if self.variant.needs_mean else index
        except PythonException as e:
            told = re.search(f"ValueError: ((?:{FAILED}|{NOT_TOKENS}).*)", str(e))
            raise ValueError(told[1] if told else str(e)) from e

    @property
    def corpus_size(self) -> int:
        return self.index.n

    @property
    def avgdl(self) -> float:
        return self.index.avgdl

    @property
    def k1(self) -> float:
        return self.variant.k1

    @property
    def b(self) -> float:
        return self.variant.b

    def preprocess_query(self, query: Sequence[str]) -> PreprocessedQuery:
        terms = _query(query)
        self._learn(terms)
        weights = self._weights
        return PreprocessedQuery(ranking.PreparedQuery(tuple((t, weights[t]) for t in terms if weights[t] is not None)))

    def _learn(self, terms: list[str]) -> None:
        """Weights of terms that were asked for before need no job."""
        if len(self._weights) > MOST_REMEMBERED:
            self._weights = {}
        new = [t for t in dict.fromkeys(terms) if t not in self._weights]
        if new:
            found = ranking.term_weights(self.index, self.variant, new)
            self._weights = self._weights | {t: found.get(t) for t in new}

    def scores(self, query: Sequence[str] | PreprocessedQuery) -> DataFrame:
        """(doc_id, score) of every document."""
        own = query if isinstance(query, PreprocessedQuery) else self.preprocess_query(query)
        return ranking.scores(self.index, self.variant, own.prepared)

    def get_scores(self, query: Sequence[str]) -> list[float]:
        return self.get_scores_numpy(query).tolist()

    def get_scores_numpy(self, query: Sequence[str]) -> np.ndarray:
        return self._dense(self.scores(query))

    @staticmethod
    def _dense(found: DataFrame) -> np.ndarray:
        return found.toPandas().sort_values("doc_id")["score"].to_numpy(np.float64)

    def get_scores_chunked(self, query: Sequence[str], chunk_size: int | None = 1000) -> list[float]:
        """get_scores; the size of chunks has no effect, as partitions are the chunks."""
        return self.get_scores(query)

    def get_scores_with_preprocessed(self, query: PreprocessedQuery) -> list[float]:
        return self._dense(self.scores(query)).tolist()

    def top_n(self, query: Sequence[str] | PreprocessedQuery, n: int | None = 5) -> DataFrame:
        """(rank, doc_id, score)."""
        own = query if isinstance(query, PreprocessedQuery) else self.preprocess_query(query)
        return ranking.top_n(self.index, self.variant, own.prepared, _count(n))

    def get_top_n_indices(self, query: Sequence[str], n: int | None = 5) -> list[tuple[int, float]]:
        own = self.preprocess_query(query)
        return ranking.top_n_rows(self.index, self.variant, own.prepared, _count(n))

    def get_top_n(self, query: Sequence[str], documents: Sequence[str] | DataFrame, n: int | None = 5) -> list[tuple[str, float]]:
        """(text, score); texts come from `documents`, which must have as many rows as the corpus."""
        if (documents.count() if isinstance(documents, DataFrame) else len(documents)) != self.corpus_size:
            raise ValueError("The documents given don't match the index corpus!")
        if isinstance(documents, DataFrame):
            found = ranking.with_text(self.top_n(query, n), documents).orderBy("rank").collect() if _count(n) else []
            return [(r["text"], r["score"]) for r in found]
        return [(documents[i], score) for i, score in self.get_top_n_indices(query, n)]

    def get_batch_scores(self, query: Sequence[str], doc_ids: Sequence[int]) -> list[float]:
        """Scores of these documents, in this order, repeats kept."""
        terms = _query(query)
        if not doc_ids:
            return []
        if any(i < 0 for i in doc_ids):
            raise OverflowError("can't convert negative int to unsigned")
        wanted = self.spark.createDataFrame(list(enumerate(doc_ids)), "pos long, doc_id long")
        if any(i >= self.corpus_size for i in doc_ids) if self.dense else not ranking.unknown_ids(self.index, wanted).isEmpty():
            raise ValueError("One or more document IDs are out of range.")
        found = ranking.scores_of(self.index, self.variant, self.preprocess_query(terms).prepared, wanted)
        return found.toPandas().sort_values("pos")["score"].tolist()

    def query_table(self, queries: Sequence[Sequence[str]]) -> DataFrame:
        """(query_id, pos, term) of a list of queries."""
        rows = [(i, pos, term) for i, query in enumerate(queries) for pos, term in enumerate(_query(query))]
        return self.spark.createDataFrame(rows, "query_id long, pos int, term string")

    def prepared_table(self, queries: Sequence[Sequence[str]] | DataFrame) -> DataFrame:
        table = queries if isinstance(queries, DataFrame) else self.query_table(queries)
        return ranking.prepared_table(self.index, self.variant, table)

    def batch_scores(self, queries: Sequence[Sequence[str]] | DataFrame) -> DataFrame:
        """(query_id, doc_id, score) of documents that share a term with the query, for all queries in one job."""
        return ranking.batch_candidates(self.index, self.variant, self.prepared_table(queries))

    def batch_top_n(self, queries: Sequence[Sequence[str]] | DataFrame, n: int = 5) -> DataFrame:
        """(query_id, rank, doc_id, score) for all queries in one job; candidates only."""
        return ranking.batch_top_n(self.index, self.variant, self.prepared_table(queries), n)

    def get_scores_batch(self, queries: Sequence[Sequence[str]]) -> list[list[float]]:
        """Scores of every document for each query."""
        if not queries:
            return []
        found = self.batch_scores(queries).toPandas()
        ids = self.index.docs.select("doc_id").toPandas()["doc_id"].sort_values().to_numpy()
        out = np.zeros((len(queries), len(ids)))
        out[found["query_id"].to_numpy(np.int64), np.searchsorted(ids, found["doc_id"].to_numpy())] = found["score"].to_numpy()
        return out.tolist()

    def save(self, path: str) -> None:
        """The index, and which variant with which parameters it was built for, as tables under path."""
        save_index(self.index, path)
        params = sorted((k, float(v)) for k, v in vars(self.variant).items())
        about = self.spark.createDataFrame([(type(self).__name__, self.dense, params)], "model string, dense boolean, params array<struct<name:string,value:double>>")
        about.coalesce(1).write.mode("overwrite").parquet(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str, tokenizer=None) -> Model:
        """A model on a saved index, without building one: of the same class, with its parameters."""
        about = spark.read.parquet(f"{path}/model").first()
        if about["model"] != cls.__name__:
            raise ValueError(f"{path} holds a {about['model']}, not a {cls.__name__}")
        model = cls.__new__(cls)
        model.variant = cls.variant_type(**{p["name"]: p["value"] for p in about["params"]})
        model.tokenizer, model.dense, model.spark = tokenizer, about["dense"], spark
        model.index, model._weights = load_index(spark, path), {}
        return model

    def close(self) -> None:
        self.index.unpersist()


class BM25Okapi(Model):
    variant_type = Okapi

    def __init__(self, corpus=None, tokenizer=None, tokenized_corpus=None, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, *, spark: SparkSession | None = None):
        super().__init__(Okapi(k1, b, epsilon), corpus, tokenizer, tokenized_corpus, spark)

    @property
    def epsilon(self) -> float:
        return self.variant.epsilon


class BM25Plus(Model):
    variant_type = Plus

    def __init__(self, corpus=None, tokenizer=None, tokenized_corpus=None, k1: float = 1.5, b: float = 0.75, delta: float = 1.0, *, spark: SparkSession | None = None):
        super().__init__(Plus(k1, b, delta), corpus, tokenizer, tokenized_corpus, spark)

    @property
    def delta(self) -> float:
        return self.variant.delta


class BM25L(Model):
    variant_type = Long

    def __init__(self, corpus=None, tokenizer=None, tokenized_corpus=None, k1: float = 1.5, b: float = 0.75, delta: float = 0.5, *, spark: SparkSession | None = None):
        super().__init__(Long(k1, b, delta), corpus, tokenizer, tokenized_corpus, spark)

    @property
    def delta(self) -> float:
        return self.variant.delta
