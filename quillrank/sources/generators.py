"""Random corpora and queries for tests and benchmarks: in the driver, repeatable by seed, or on the executors."""

from __future__ import annotations

import random
import string
from bisect import bisect
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def vocabulary(size: int, rng: random.Random, lengths: tuple[int, int] = (3, 10)) -> list[str]:
    return ["".join(rng.choices(string.ascii_lowercase, k=rng.randint(*lengths))) for _ in range(size)]


def random_corpus(num_docs: int, avg_doc_length: int = 100, vocab_size: int = 10_000, seed: int | None = None) -> list[str]:
    """Uniform words of 3 to 10 letters; lengths are normal with a deviation of 0.3 of the mean, 10 words at least."""
    rng = random.Random(seed)
    words = vocabulary(vocab_size, rng)
    sizes = lambda: max(10, int(rng.normalvariate(avg_doc_length, 0.3 * avg_doc_length)))
    return [" ".join(rng.choices(words, k=sizes())) for _ in range(num_docs)]


def zipf_corpus(num_docs: int, avg_doc_length: int = 50, vocab_size: int = 50_000, seed: int | None = None) -> list[str]:
    """As random_corpus, but the word of rank i has weight 1 / i."""
    rng = random.Random(seed)
    words = vocabulary(vocab_size, rng)
    weights = list(accumulate(1 / (i + 1) for i in range(vocab_size)))
    pick = lambda: words[min(bisect(weights, rng.random() * weights[-1]), vocab_size - 1)]
    return [" ".join(pick() for _ in range(max(10, int(rng.normalvariate(avg_doc_length, 0.3 * avg_doc_length))))) for _ in range(num_docs)]


def random_queries(words: list[str], num_queries: int, query_length_range: tuple[int, int] = (2, 5), seed: int | None = None) -> list[str]:
    """Queries of words drawn from the first 1000 of a vocabulary."""
    rng = random.Random(seed)
    return [" ".join(rng.choices(words[:1000], k=rng.randint(*query_length_range))) for _ in range(num_queries)]


def random_documents(spark: SparkSession, num_docs: int, doc_length: int = 100, vocab_size: int = 10_000, zipf: bool = False, seed: int = 0) -> DataFrame:
    """(doc_id, text) made on the executors, for any number of documents. Words are w0, w1, ...

    zipf: ranks are spread as exp of a uniform number, so rank i has about weight 1 / i.
    """
    ids = spark.range(num_docs).withColumnRenamed("id", "doc_id")
    share = lambda i: F.pmod(F.xxhash64(F.col("doc_id"), i, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    rank = lambda i: F.floor(F.pow(F.lit(float(vocab_size)), share(i)) - 1 if zipf else share(i) * vocab_size)
    words = F.transform(F.sequence(F.lit(1), F.lit(doc_length)), lambda i: F.concat(F.lit("w"), rank(i).cast("string")))
    return ids.select("doc_id", F.array_join(words, " ").alias("text"))
