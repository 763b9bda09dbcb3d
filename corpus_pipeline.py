"""A corpus from raw documents to packed sequences: quality, exact copies, near copies, secrets, packing.

Each stage takes any table with the columns of documents. Null texts count as empty; all rows of an empty table are kept
and there are none; rows that repeat an id are rows of their own unless a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm import exact_dedup, ngram_jaccard, packing, quality_rules, secret_scan
from quillrank.llm.common import exists, remove, shared_path, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject: null and empty texts among them; repeated rows fare alike."""
    return quality_rules.keep_good(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts; ties go to the smallest id, repeated rows leave one."""
    return exact_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component of near copies; texts without words and null ids stay."""
    return ngram_jaccard.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redacts secrets; n_chars follows the text. Every row stays, null texts as null."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; null and empty texts are the end token alone."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("exact_dedup", exact_copies), ("ngram_jaccard", near_copies), ("secret_scan", secrets), ("best_fit_packing", packed)]

#: The stages train a model and tokenise, which SQL can't express; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again.

    folder: where the copies lie (None: a new folder). A copy that is complete there is taken as it is, so a run that
    broke off goes on from its last stage. A copy is deleted when the next stage has used it, the last one when the
    pieces to pack are checkpointed.
    """
    folder, docs, last = folder or shared_path(spark, "pipeline"), table(spark, sf_dir, "documents"), None
    done = [f"{folder}/{name}" for name, _ in STAGES[:-1]]
    begun = max((i + 1 for i, path in enumerate(done) if exists(spark, f"{path}/_SUCCESS")), default=0)
    for i, (path, (_, stage)) in enumerate(zip(done, STAGES)):
        if i >= begun:
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
            if last:
                remove(spark, last)
        if i + 1 >= begun:
            docs, last = spark.read.parquet(path), path
    packed_ = STAGES[-1][1](spark, docs, sf_dir)
    remove(spark, folder)
    return packed_
