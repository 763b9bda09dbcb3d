"""Taking few rows out of a large table of texts without shuffling the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.llm.bloom import build, probe
from quillrank.llm.common import checkpointed


def looked_up(rows: DataFrame, key: Column, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(apart, maybe): rows whose key is certainly not in the one-column table `wanted`, and the others.

    Only the others need a join. The Bloom filter that parts them has a bounded size.
    """
    wanted = checkpointed(wanted.distinct())
    listed = probe(build(wanted.select(F.xxhash64(wanted.columns[0]).alias("hash")), wanted.count()), rows.sparkSession)
    maybe = F.coalesce(listed(F.xxhash64(key)), F.lit(False))
    return rows.where(~maybe), rows.where(maybe)


def without(rows: DataFrame, id_col: str, dropped: DataFrame) -> DataFrame:
    """Rows whose id isn't in the one-column table `dropped`, with all their columns. Null ids stay, repeated rows too."""
    packed = rows.select(F.struct(*rows.columns).alias("row"), F.col(id_col).alias("id"))
    apart, maybe = looked_up(packed, F.col("id"), dropped)
    left = maybe.join(dropped.toDF("id").distinct(), "id", "left_anti")
    return apart.select("row.*").unionByName(left.select("row.*"))
