"""The registered queries: each operator over its whole table, with production parameters, as a digest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm import ngram_jaccard, packing, quality_classifier, quality_rules, secret_scan, sentencepiece_codec, suffix_dedup, url_filter
from quillrank.llm.common import table
from quillrank.llm.exact_dedup import exact_dedup
from quillrank.llm.line_dedup import line_dedup


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.quality_scores(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"), url_filter.rules_table(spark))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.quality_rules(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels"))).drop("probability")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes a ledger into the shared folder, one for each run and table, and joins the findings from there."""
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents"))[0])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_suffix_dedup, op2_exact_dedup, op3_quality_classifier, op4_best_fit_packing, op5_sentencepiece,
        op6_ngram_jaccard, op7_url_filter, op8_quality_rules, op9_secret_scan, op10_line_dedup,
    )
    return {f.__name__: f for f in found}
