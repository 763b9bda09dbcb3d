"""A bounded, repeatable sample of labelled documents for the trained models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on at most. Labels beyond it are not read into the driver.
MOST_LABELLED = 6000


def labelled_ids(labels: DataFrame, label_col: str, where: Column | None = None, most: int = MOST_LABELLED) -> DataFrame:
    """doc_id and label (0 or 1) of at most `most` rows, chosen by a hash of the id: a top-k, not an order of arrival.

    Rows without id or label are left out; of an id with several labels the smallest counts.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1))
    rows = rows.where(where) if where is not None else rows
    rows = rows.groupBy("doc_id").agg(F.min(label_col).cast("int").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def labelled_texts(docs: DataFrame, labels: DataFrame, label_col: str, where: Column | None = None, most: int = MOST_LABELLED) -> DataFrame:
    """doc_id, label and text of the sample; at most `most` ids are broadcast."""
    chosen = labelled_ids(labels, label_col, where, most)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")
