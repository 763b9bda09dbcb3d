"""Streams of queries against a static index (an extension: the ranking itself has no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from quillrank.functions.weights import Variant
from quillrank.operators.index import Index
from quillrank.operators.ranking import batch_top_n, prepared_table


def answers(index: Index, variant: Variant, queries: DataFrame, path: str, n: int = 5) -> DataStreamWriter:
    """Writes (batch_id, query_id, rank, doc_id, score) of a stream (query_id, tokens) to Parquet, a folder a batch.

    A batch that is run again after a failure overwrites its own folder, so each query is answered once.
    """

    def answer(batch: DataFrame, batch_id: int) -> None:
        terms = batch.select("query_id", F.posexplode("tokens").alias("pos", "term"))
        found = batch_top_n(index, variant, prepared_table(index, variant, terms), n)
        found.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return queries.writeStream.foreachBatch(answer)
