"""The inverted index as tables: documents, postings, terms, and three numbers about the corpus."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions.tokenizers import DefaultTokenizer
from quillrank.functions.weights import Okapi, Variant


def tokenised(docs: DataFrame, tokenizer=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens); the tokenizer is a Column expression, so this is a projection of the scan."""
    return docs.select(F.col(id_col).alias("doc_id"), (tokenizer or DefaultTokenizer()).column(F.col(text_col)).alias("tokens"))


def positions(tokens: DataFrame) -> DataFrame:
    """(doc_id, pos, term)."""
    return tokens.select("doc_id", F.posexplode("tokens").alias("pos", "term"))


def doc_lengths(tokens: DataFrame) -> DataFrame:
    """(doc_id, dl), without a shuffle."""
    return tokens.select("doc_id", F.size("tokens").alias("dl"))


def postings_of(tokens: DataFrame) -> DataFrame:
    """(term, doc_id, tf, dl), without a shuffle; dl rides along, so scoring needs no join with the documents.

    A document's tokens are in one row: sorted, each run of equal ones is a term with its frequency.
    """
    rows = tokens.select("doc_id", F.size("tokens").alias("dl"), F.sort_array("tokens").alias("t"))
    # not a filter on dl: that would be pushed below the tokenizer and run it twice
    places = F.when(F.col("dl") > 0, F.sequence(F.lit(0), F.greatest(F.col("dl") - 1, F.lit(0))))
    begins = F.filter(places, lambda i: (i == 0) | (F.get("t", i) != F.get("t", i - 1)))
    rows = rows.select("doc_id", "dl", "t", begins.alias("begins"))
    each = F.transform("begins", lambda i, k: F.struct(F.get("t", i).alias("term"), (F.coalesce(F.get("begins", k + 1), F.col("dl")) - i).alias("tf")))
    return rows.select("doc_id", "dl", F.inline(each)).select("term", "doc_id", "tf", "dl")


def doc_frequencies(postings: DataFrame) -> DataFrame:
    """(term, df)."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: n, total_len, avgdl."""
    out = lengths.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_len"))
    return out.withColumn("avgdl", F.try_divide(F.col("total_len").cast("double"), F.col("n").cast("double")))


def mean_raw_idf(terms: DataFrame, n: int) -> float:
    """Mean of the raw idf over all distinct terms.

    Terms are counted by df first and these counts summed in the order of df: the result doesn't depend on how the
    terms are partitioned. There are at most about sqrt(2 * postings) different df.
    """
    raw = Okapi().raw_idf
    by_df = terms.groupBy("df").agg(F.count(F.lit(1)).alias("c"))
    every = by_df.agg(F.array_sort(F.collect_list(F.struct("df", "c"))).alias("every"))
    total = F.aggregate("every", F.lit(0.0), lambda acc, x: acc + x["c"].cast("double") * raw(x["df"], n))
    distinct = F.aggregate("every", F.lit(0).cast("long"), lambda acc, x: acc + x["c"])
    return every.select(F.try_divide(total, distinct.cast("double"))).first()[0] or 0.0


@dataclass(frozen=True)
class Index:
    """docs (doc_id, dl), postings (term, doc_id, tf, dl), terms (term, df), and the corpus' numbers."""

    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    n: int
    total_len: int
    mean_idf: float | None = None

    @property
    def avgdl(self) -> float:
        return self.total_len / self.n if self.n else 0.0

    @property
    def spark(self) -> SparkSession:
        return self.docs.sparkSession

    def weighted(self, variant: Variant) -> DataFrame:
        """(term, df, idf)."""
        return self.terms.withColumn("idf", self.idf(variant, F.col("df")))

    def idf(self, variant: Variant, df: Column) -> Column:
        mean = 0.0
        if variant.needs_mean:
            mean = self.mean_idf if self.mean_idf is not None else mean_raw_idf(self.terms, self.n)
        return variant.idf(df, self.n, mean)

    def with_mean(self) -> Index:
        return self if self.mean_idf is not None else replace(self, mean_idf=mean_raw_idf(self.terms, self.n))

    def unpersist(self) -> None:
        for table in (self.docs, self.postings, self.terms):
            table.unpersist()


def build_index(tokens: DataFrame, persist: bool = False) -> Index:
    """An index of (doc_id, tokens). The corpus' numbers are computed now; with persist, the tables too."""
    lengths, postings = doc_lengths(tokens), postings_of(tokens)
    if persist:
        postings = postings.persist(StorageLevel.MEMORY_AND_DISK)
        lengths = lengths.persist(StorageLevel.MEMORY_AND_DISK)
    terms = doc_frequencies(postings)
    if persist:
        terms = terms.persist(StorageLevel.MEMORY_AND_DISK)
    stats = corpus_stats(lengths).first()
    return Index(lengths, postings, terms, stats["n"], stats["total_len"])


def save_index(index: Index, path: str) -> None:
    """Parquet with postings dealt by range of (term, doc_id) and sorted, so a query's terms prune row groups.

    The document is in the range key too, so that a term that every document has fills many files, not one.
    """
    postings = index.postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
    postings.write.mode("overwrite").parquet(f"{path}/postings")
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")
    index.terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    index = index.with_mean()
    numbers = index.spark.createDataFrame([(index.n, index.total_len, index.mean_idf)], "n long, total_len long, mean_idf double")
    numbers.coalesce(1).write.mode("overwrite").parquet(f"{path}/numbers")


def load_index(spark: SparkSession, path: str) -> Index:
    numbers = spark.read.parquet(f"{path}/numbers").first()
    docs, postings, terms = (spark.read.parquet(f"{path}/{t}") for t in ("docs", "postings", "terms"))
    return Index(docs, postings, terms, numbers["n"], numbers["total_len"], numbers["mean_idf"])
