"""Quality classifier: Bradley-Terry scores from preference pairs, thresholded by a quantile of the scores.

A document's strength is linear in its features: 16 statistics of the whole text, standardised, and two hinges of each
(what it exceeds +0.5 by, and what it falls short of -0.5 by). Pairs prefer a document labelled 1 over one labelled 0;
the weights minimise the logistic loss of the differences of their features (with ridge), by Newton's method. The threshold is the quantile of the training scores
at the share of label 0 that leaves the fewest errors; a score is the logistic of the distance from it, moved so that
the threshold scores 0.3.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import small_batches
from quillrank.llm.statistics import FEATURES, counts, features
from quillrank.llm.training_rows import MOST_LABELLED, labelled_texts
from quillrank.sources.corpus import spread

#: The score at the threshold.
CUT = 0.3
#: Pairs that are drawn for training at most, and their seed.
MOST_PAIRS, SEED = 60_000, 11
_FOLDS = 5


def held_out() -> F.Column:
    """crc32 of the id as text is a multiple of 5; a null id is as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % _FOLDS == 0


def vector(text: str) -> np.ndarray:
    """Statistics of a whole text."""
    return np.array(features(text, *counts(text)))


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([z, np.maximum(z - 0.5, 0), np.maximum(-0.5 - z, 0)], axis=1)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.strength(x) - self.cut) + np.log(CUT / (1 - CUT)), -500, 500)))


def fit_pairs(x: np.ndarray, y: np.ndarray, ridge: float = 3.0, steps: int = 25) -> Model:
    """The model of feature rows x and labels y. Without two kinds of labels every score is a half."""
    d = x.shape[1]
    mean, scale = (x.mean(0), x.std(0)) if len(x) else (np.zeros(d), np.ones(d))
    scale = np.where(scale > 1e-9, scale, 1.0)
    model = Model(mean, scale, np.zeros(3 * d), 0.0, 1.0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Model(mean, scale, np.zeros(3 * d), -np.log((1 - CUT) / CUT), 1.0)
    z, rng = model.expand(x), np.random.default_rng(SEED)
    diffs = z[rng.choice(good, MOST_PAIRS)] - z[rng.choice(bad, MOST_PAIRS)]
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(diffs @ w, -50, 50)))  # of losing
        grad = ridge * w - diffs.T @ p
        step = np.linalg.solve((diffs * (p * (1 - p))[:, None]).T @ diffs + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    cut = _quantile(s, y)
    spread = max(1e-9, np.median(np.abs(s - cut)))
    return Model(mean, scale, w, cut, 4.0 / spread)


def _quantile(s: np.ndarray, y: np.ndarray) -> float:
    """The score between two training scores below which label 0 is likelier: fewest errors, then nearest the share of label 0."""
    order = np.argsort(s, kind="stable")
    s, y = s[order], y[order]
    errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    fewest = np.flatnonzero(errors == errors.min())
    k = int(fewest[np.abs(fewest - (1 - y).sum()).argmin()])
    ends = np.concatenate([[s[0] - 1], s, [s[-1] + 1]])
    return float((ends[k] + ends[k + 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """Fitted in the driver on at most `most` labelled rows that aren't held out; features come from the executors."""
    small_batches(docs.sparkSession)

    def computed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"], "x": [vector(t) for t in batch["text"]]})

    rows = labelled_texts(docs, labels, "quality", ~held_out(), most).select("label", "text").mapInPandas(computed, "label int, x array<double>").toPandas()
    x, y = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES)), rows["label"].to_numpy(int)
    order = np.lexsort((*x.T, y))
    return fit_pairs(x[order], y[order])


def quality_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.3).

    Null text counts as empty, and empty texts have a score. Repeated rows and null ids stay; other columns are not
    read; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array([vector(t) for t in batch["text"]]).reshape(-1, len(FEATURES))
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "held_out": batch["held_out"], "score": shared.value.score(x)})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", held_out().alias("held_out"), "text")
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas has no null in integers
    scores = spread(rows).mapInPandas(scored, "doc_id string, held_out boolean, score double")
    return scores.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType)).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
