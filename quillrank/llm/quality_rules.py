"""Quality rules: stated base rules, then boosted trees over document statistics.

The trees are trained in the driver on a bounded sample of labelled documents (training_rows.MOST_LABELLED), whose
statistics are computed on the executors, and broadcast as flat node arrays. More symbols, repeated lines and repeated
words can only lower a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.boosted_trees import Trees, train
from quillrank.llm.common import small_batches
from quillrank.llm.statistics import FEATURES, counts, features
from quillrank.llm.training_rows import MOST_LABELLED, labelled_texts
from quillrank.sources.corpus import spread

#: A document is rejected when the trees give label 1 less than this. Well under a half, so that clean documents stay.
LEAST_PROBABILITY = 0.3
#: Base rules, in exact integers.
LEAST_WORDS, MOST_REPEAT_PERCENT = 50, 50
LOWERS = ("symbol_share", "dup_line_share", "repeat_share", "top_word_share", "pipe_share", "adjacent_share")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics_table(texts: DataFrame) -> DataFrame:
    """label and the features of each row of a table with label and text."""

    small_batches(texts.sparkSession)

    def computed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"], "x": [features(t, *counts(t)) for t in batch["text"]]})

    return texts.select("label", "text").mapInPandas(computed, "label int, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Trees:
    """Trees for labels.quality. Without two kinds of labels they reject nothing that the base rules keep."""
    rows = statistics_table(labelled_texts(docs, labels, "quality", most=most)).toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    y = rows["label"].to_numpy(float)
    order = np.lexsort((*x.T, y))  # sums don't depend on the order of arrival
    x, y = x[order], y[order]
    if not 0 < y.sum() < len(y):
        x, y = x[:0], y[:0]
    return train(x, y, np.array([-1 if f in LOWERS else 0 for f in FEATURES]))


def verdicts(texts: list[str], trees: Trees, least: float = LEAST_PROBABILITY) -> pd.DataFrame:
    """A row for each text: the counts, base_failed, probability, kept."""
    rows, x = [], np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        found, words, lines = counts(text)
        rows.append([found[k] for k in COUNTS])
        x[i] = features(text, found, words, lines)
    out = pd.DataFrame(np.array(rows, np.int64).reshape(-1, len(COUNTS)), columns=list(COUNTS))
    out["base_failed"] = (out["n_words"] < LEAST_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEAT_PERCENT * out["n_words"])
    out["probability"] = trees.probability(x)
    out["kept"] = ~out["base_failed"] & (out["probability"] >= least)
    return out


def quality_rules(docs: DataFrame, trees: Trees, least: float = LEAST_PROBABILITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, the five counts, base_failed, kept, probability.

    base_failed: under 50 words, or more than half of the words in repeated 3-word windows. kept: not base_failed, and
    the trees' probability of good quality is at least `least`. Null and empty texts have no words and fail. Repeated
    rows and null ids stay; other columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield verdicts(batch["text"].tolist(), shared.value, least).assign(doc_id=batch["doc_id"].to_numpy())

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = ", ".join(f"{k} long" for k in COUNTS) + ", base_failed boolean, probability double, kept boolean, doc_id string"
    found = spread(rows).mapInPandas(judged, schema).withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))
    return found.select("doc_id", *COUNTS, "base_failed", "kept", "probability")


def keep_good(docs: DataFrame, trees: Trees, least: float = LEAST_PROBABILITY, text_col: str = "text") -> DataFrame:
    """The input rows that are kept, with all their columns.

    Null and empty texts have no words and go. Repeated rows fare alike, null ids play no part; column names may be any;
    an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array(verdicts(texts, shared.value, least)["kept"].to_numpy()))

    return spread(docs).mapInArrow(kept, docs.schema)
