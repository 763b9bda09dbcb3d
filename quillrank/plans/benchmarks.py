"""Timings of building, single queries, batches, subsets and concurrent queries."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from statistics import mean

from quillrank.plans.models import BM25L, BM25Okapi, BM25Plus, Model
from quillrank.sources.generators import random_corpus, random_queries


def timed(action: Callable[[], object]) -> float:
    began = time.perf_counter()
    action()
    return time.perf_counter() - began


def benchmark_build(sizes: Sequence[int], model: type[Model] = BM25Okapi, avg_doc_length: int = 100, **params) -> list[dict]:
    out = []
    for size in sizes:
        corpus = random_corpus(size, avg_doc_length, seed=42)
        built: list[Model] = []
        seconds = timed(lambda c=corpus, b=built: b.append(model(c, **params)))
        built[0].close()
        out.append({"docs": size, "seconds": seconds, "docs_per_second": size / seconds})
    return out


def benchmark_queries(model: Model, queries: Sequence[Sequence[str]], n: int = 10) -> dict:
    times = [timed(lambda q=q: model.get_top_n_indices(q, n)) for q in queries]
    return {"queries": len(times), "mean_seconds": mean(times), "slowest_seconds": max(times)}


def benchmark_batch(model: Model, queries: Sequence[Sequence[str]], n: int = 10) -> dict:
    """All queries in one job."""
    seconds = timed(lambda: model.batch_top_n(queries, n).write.format("noop").mode("overwrite").save())
    return {"queries": len(queries), "seconds": seconds, "queries_per_second": len(queries) / seconds}


def benchmark_subset(model: Model, queries: Sequence[Sequence[str]], sizes: Sequence[int]) -> list[dict]:
    out = []
    for size in (s for s in sizes if s <= model.corpus_size):
        ids = list(range(size))
        seconds = mean(timed(lambda q=q, ids=ids: model.get_batch_scores(q, ids)) for q in queries)
        out.append({"doc_ids": size, "mean_seconds": seconds})
    return out


def benchmark_concurrent(model: Model, queries: Sequence[Sequence[str]], threads: int = 4, n: int = 10) -> dict:
    """Threads that share one session; each query is a job of its own."""
    with ThreadPoolExecutor(threads) as pool:
        seconds = timed(lambda: list(pool.map(lambda q: model.get_top_n_indices(q, n), queries)))
    return {"threads": threads, "queries": len(queries), "seconds": seconds, "queries_per_second": len(queries) / seconds}


#: Corpus sizes for building; threads, and queries of each, that run at the same time.
SIZES, THREADS, OF_THREAD = (1_000, 5_000, 10_000, 25_000), 4, 250


def benchmark_bm25(
    corpus_sizes: Sequence[int] = SIZES, query_corpus_size: int = 10_000, num_queries: int = 1000,
    bm25_variants: Sequence[type[Model]] = (BM25Okapi, BM25Plus, BM25L), include_concurrent: bool = True, of_thread: int = OF_THREAD, **params,
) -> dict:
    """Building, queries (all one by one, all in one job, on subsets) and concurrent queries, for each model's name."""
    out: dict[str, dict] = {"initialization": {}, "query_performance": {}, "concurrent_performance": {}}
    corpus = random_corpus(query_corpus_size, seed=42)
    words = sorted({w for text in corpus[:200] for w in text.split()})
    queries = [q.split() for q in random_queries(words, num_queries, seed=7)]
    for model in bm25_variants:
        name = model.__name__
        out["initialization"][name] = benchmark_build(corpus_sizes, model, **params)
        built = model(corpus, **params)
        try:
            out["query_performance"][name] = {
                "single": benchmark_queries(built, queries),
                "batch": benchmark_batch(built, queries),
                "subset": benchmark_subset(built, queries[:3], [10, 100, 1000, 5000]),
            }
            if include_concurrent:
                out["concurrent_performance"][name] = benchmark_concurrent(built, [q.split() for q in random_queries(words, THREADS * of_thread, seed=8)], THREADS)
        finally:
            built.close()
    return out
