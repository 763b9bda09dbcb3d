"""Inverse document frequencies and term scores of the three variants, as Column expressions over DOUBLE.

The order of evaluation is part of the contract: ties between documents are decided by it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


def _lit(x: float) -> Column:
    return F.lit(float(x))


@dataclass(frozen=True)
class Okapi:
    """Classic weights; a negative idf is raised to epsilon times the mean idf of all terms."""

    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25

    needs_mean = True

    def raw_idf(self, df: Column, n: int) -> Column:
        df = df.cast("double")
        return F.log((_lit(n) - df + _lit(0.5)) / (df + _lit(0.5)))

    def idf(self, df: Column, n: int, mean: float) -> Column:
        raw = self.raw_idf(df, n)
        return F.when(raw < 0, _lit(self.epsilon * mean)).otherwise(raw)

    def term(self, idf: Column, tf: Column, length: Column) -> Column:
        return idf * ((tf * _lit(self.k1 + 1)) / (tf + _lit(self.k1) * length))


@dataclass(frozen=True)
class Plus:
    """Lower-bounded weights: delta is added inside the numerator, to documents that have the term."""

    k1: float = 1.5
    b: float = 0.75
    delta: float = 1.0

    needs_mean = False

    def idf(self, df: Column, n: int, mean: float = 0.0) -> Column:
        return F.log(_lit(n + 1)) - F.log(df.cast("double"))

    def term(self, idf: Column, tf: Column, length: Column) -> Column:
        return idf * ((_lit(self.delta) + tf * _lit(self.k1 + 1)) / (_lit(self.k1) * length + tf))


@dataclass(frozen=True)
class Long:
    """Length-corrected weights: delta is added to the length-normalised frequency."""

    k1: float = 1.5
    b: float = 0.75
    delta: float = 0.5

    needs_mean = False

    def idf(self, df: Column, n: int, mean: float = 0.0) -> Column:
        return F.log(_lit(n + 1)) - F.log(df.cast("double") + _lit(0.5))

    def term(self, idf: Column, tf: Column, length: Column) -> Column:
        c = F.when(length > 0, tf / length).otherwise(_lit(0))
        under = _lit(self.k1) + c + _lit(self.delta)
        return F.when(under > 0, (idf * (_lit(self.k1 + 1) * (c + _lit(self.delta)))) / under).otherwise(_lit(0))


Variant = Okapi | Plus | Long
VARIANTS = {"okapi": Okapi(), "plus": Plus(), "l": Long()}


def with_params(variant: Variant, **changes: float) -> Variant:
    return replace(variant, **changes)


def length_part(variant: Variant, dl: Column, avgdl: float) -> Column:
    """(1 - b) + (b / avgdl) * dl. With an average of zero there is no posting to apply it to."""
    return _lit(1 - variant.b) + _lit(variant.b / avgdl if avgdl else 0.0) * dl.cast("double")


def term_score(variant: Variant, idf: Column, tf: Column, dl: Column, avgdl: float) -> Column:
    return variant.term(idf, tf.cast("double"), length_part(variant, dl, avgdl))
