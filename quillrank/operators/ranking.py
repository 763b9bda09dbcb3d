"""Scores and rankings over an Index, as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions.weights import Variant, term_score
from quillrank.operators.index import Index

#: Terms of queries, all together, up to which they are broadcast: at some 100 bytes each, 20 MB.
MOST_BROADCAST = 200_000
#: Distinct terms up to which a single query is an aggregate for each term; longer queries are joined as a table.
MOST_COLUMNS = 24


@dataclass(frozen=True)
class PreparedQuery:
    """In-vocabulary terms of a query in order, repeats kept, each with its idf in one index."""

    terms: tuple[tuple[str, float], ...]

    def __len__(self) -> int:
        return len(self.terms)


def prepare(index: Index, variant: Variant, query: Sequence[str]) -> PreparedQuery:
    """Terms are matched as they are. A row for each distinct term comes to the driver, at most."""
    idf = term_weights(index, variant, query)
    return PreparedQuery(tuple((t, idf[t]) for t in query if t in idf))


def term_weights(index: Index, variant: Variant, terms: Sequence[str]) -> dict[str, float]:
    """idf of those terms that are in the vocabulary."""
    wanted = list(dict.fromkeys(terms))
    if not wanted:
        return {}
    return {r["term"]: r["idf"] for r in index.weighted(variant).where(F.col("term").isin(wanted)).select("term", "idf").collect()}


def prepared_table(index: Index, variant: Variant, queries: DataFrame) -> DataFrame:
    """(query_id, pos, term, idf) of queries (query_id, pos, term); terms outside the vocabulary drop out.

    Queries of a checked size are marked for broadcast, here to the terms and then to the postings; more are shuffled.
    """
    weights, columns = index.weighted(variant).select("term", "idf"), ["query_id", "pos", "term", "idf"]
    if queries.limit(MOST_BROADCAST + 1).count() > MOST_BROADCAST:
        return queries.join(weights, "term").select(*columns)
    return F.broadcast(F.broadcast(queries).join(weights, "term").select(*columns))


def candidates(index: Index, variant: Variant, query: PreparedQuery, doc_ids: DataFrame | None = None) -> DataFrame:
    """(doc_id, score) of documents with a term of the query; of those in doc_ids only, if given.

    Terms and their idf are literals: the filter on terms reaches the scan, and there is no join. Scores add up in the
    order of the query, so equal documents have equal scores to the last bit.
    """
    if len({t for t, _ in query.terms}) > MOST_COLUMNS:
        rows = [(0, i, t, w) for i, (t, w) in enumerate(query.terms)]
        table = index.spark.createDataFrame(rows, "query_id long, pos int, term string, idf double")
        return batch_candidates(index, variant, table, doc_ids).select("doc_id", "score")
    weights = dict(query.terms)
    matched = index.postings.where(F.col("term").isin(list(weights)))
    if doc_ids is not None:
        matched = matched.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    each = [
        F.coalesce(F.max(F.when(F.col("term") == t, term_score(variant, F.lit(w), F.col("tf"), F.col("dl"), index.avgdl))), F.lit(0.0)).alias(f"s{i}")
        for i, (t, w) in enumerate(weights.items())
    ]
    place = {t: f"s{i}" for i, t in enumerate(weights)}
    total: Column = F.lit(0.0)
    for t, _ in query.terms:
        total = total + F.col(place[t])
    return matched.groupBy("doc_id").agg(*each).select("doc_id", total.alias("score")) if each else _nothing(index)


def _nothing(index: Index) -> DataFrame:
    return index.docs.select("doc_id", F.lit(0.0).alias("score")).limit(0)


def batch_candidates(index: Index, variant: Variant, prepared: DataFrame, doc_ids: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score) for all queries in one job. Scores add up in the order of each query.

    Where the postings are dealt by document and the queries are broadcast, no hit is shuffled: a document's sums are
    made in the partition that holds it.
    """
    postings = index.postings
    if doc_ids is not None:
        postings = postings.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    hits = postings.join(prepared, "term")
    hits = hits.select("query_id", "doc_id", "pos", term_score(variant, F.col("idf"), F.col("tf"), F.col("dl"), index.avgdl).alias("x"))
    # a running sum adds in the order of the window; the last row of a group has it all
    in_order = Window.partitionBy("query_id", "doc_id").orderBy("pos")
    running = F.sum("x").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = hits.select("query_id", "doc_id", running.alias("score"), F.lead("pos").over(in_order).isNull().alias("last"))
    return summed.where("last").select("query_id", "doc_id", "score")


def scores(index: Index, variant: Variant, query: PreparedQuery) -> DataFrame:
    """(doc_id, score), a row for every document; those without a term have 0."""
    if not len(query):
        return index.docs.select("doc_id", F.lit(0.0).alias("score"))
    found = candidates(index, variant, query)
    return index.docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def scores_of(index: Index, variant: Variant, query: PreparedQuery, wanted: DataFrame) -> DataFrame:
    """(pos, doc_id, score) of wanted (pos, doc_id): in the caller's order, repeats kept."""
    if not len(query):
        return wanted.select("pos", "doc_id", F.lit(0.0).alias("score"))
    found = candidates(index, variant, query, wanted)
    return wanted.join(found, "doc_id", "left").select("pos", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def unknown_ids(index: Index, wanted: DataFrame) -> DataFrame:
    return wanted.join(index.docs.select("doc_id"), "doc_id", "left_anti")


def batch_scores(index: Index, variant: Variant, query_ids: DataFrame, prepared: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) for every query and every document. Large by definition; batch_candidates is the sparse form."""
    every = query_ids.select("query_id").distinct().join(index.docs.select("doc_id"), how="cross")
    found = batch_candidates(index, variant, prepared)
    return every.join(found, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def _ranked(rows: DataFrame, n: int) -> DataFrame:
    """(rank, doc_id, score) of at most n rows, in the order of (matched, score, doc_id)."""
    best = rows.orderBy(F.desc("matched"), F.desc("score"), "doc_id").limit(n)
    whole = Window.orderBy(F.desc("matched"), F.desc("score"), "doc_id")
    return best.select(F.row_number().over(whole).alias("rank"), "doc_id", "score")


def top_n_rows(index: Index, variant: Variant, query: PreparedQuery, n: int = 5) -> list[tuple[int, float]]:
    """top_n as rows in the driver, n of them at most: one job, and another only if there are fewer candidates."""
    if n == 0:
        return []
    best = []
    if len(query):
        found = candidates(index, variant, query).orderBy(F.desc("score"), "doc_id").limit(n).collect()
        best = [(r["doc_id"], r["score"]) for r in found]
    if len(best) < n:
        taken = {i for i, _ in best}
        first = index.docs.select("doc_id").orderBy("doc_id").limit(2 * n).collect()
        best += [(r["doc_id"], 0.0) for r in first if r["doc_id"] not in taken][: n - len(best)]
    return best


def top_n(index: Index, variant: Variant, query: PreparedQuery, n: int = 5) -> DataFrame:
    """(rank, doc_id, score): candidates by (score descending, doc_id), then documents without a term, by doc_id, with 0.

    Documents without a term come last even behind negative scores. Of these, the first 2n documents hold enough: if
    fewer than n candidates exist, they hide at most n of them.
    """
    first = index.docs.select("doc_id").orderBy("doc_id").limit(2 * n)
    filler = first.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("matched"))
    if not len(query):
        return _ranked(filler, n)
    best = candidates(index, variant, query).withColumn("matched", F.lit(1)).orderBy(F.desc("score"), "doc_id").limit(n)
    both = best.unionByName(filler).groupBy("doc_id").agg(F.max_by("score", "matched").alias("score"), F.max("matched").alias("matched"))
    return _ranked(both, n)


def batch_top_n(index: Index, variant: Variant, prepared: DataFrame, n: int = 5) -> DataFrame:
    """(query_id, rank, doc_id, score) of the candidates of each query. Of a partition, n rows a query are shuffled."""
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    found = batch_candidates(index, variant, prepared).withColumn("rank", F.row_number().over(by_query))
    return found.where(F.col("rank") <= n).select("query_id", "rank", "doc_id", "score")


def with_text(ranked: DataFrame, documents: DataFrame) -> DataFrame:
    """(rank, text, score) of ranked rows, with texts of documents (doc_id, text). Their limit tells the optimizer their size."""
    return documents.join(ranked, "doc_id").select("rank", "text", "score")
