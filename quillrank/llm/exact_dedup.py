"""Exact deduplication by a content sort, in DataFrame operations only.

The normalised bytes are dealt out by range with sampled splitters, sorted within each range (Spark's external sort
spills), and each row is compared in full with its neighbour. The range key is (leading bytes, SHA-256, salt): the
leading bytes and the digest bound what a splitter holds, however long the texts are. So within equal leading bytes the
order is by digest and then by the whole body; equal bodies are adjacent either way, and it is bodies that are compared.

Skew. A text with more than its share of the rows is found by a count of 64-bit hashes (combined before the shuffle)
and gets a salt, so its copies are sorted in several ranges; only the heads of those parts, a few for each such text,
meet again, and are again compared in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quillrank.llm.common import checkpointed, hot_share, shuffle_partitions, squeezed

#: Bytes of the normalised text that lead the range key.
LEADING = 24


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without `[\\x20\\x09-\\x0D]`. Of equal texts the row with the most code points in
    its original text stays, then the one with the smallest id. Null text counts as empty; empty texts are equal to
    each other. A null id sorts after every other id. Rows that repeat an id are rows of their own in group_size;
    repeats of the row that stays are all kept. Other columns are ignored. An empty table gives an empty result.
    """
    ranges = shuffle_partitions(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.char_length(text).alias("n"), squeezed(text).alias("body"))
    hashed = base.withColumn("hash", F.xxhash64("body"))
    keyed = hashed.join(F.broadcast(_hot(hashed, ranges)), "hash", "left").select(
        "doc_id", "n", "body", F.sha2("body", 256).alias("sha"), F.col("parts").isNotNull().alias("hot"),
        F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("parts"))).cast("int").alias("salt"),
        F.substring(F.encode("body", "UTF-8"), 1, LEADING).alias("lead"),
    )
    dealt = keyed.repartitionByRange(ranges, "lead", "sha", "salt")
    classes = _numbered(dealt, Window.partitionBy("lead", "sha", "salt").orderBy("body", *_best()))
    body = F.when(F.col("hot") & F.col("head"), F.col("body"))
    classes = checkpointed(classes.select("doc_id", "n", "sha", "hot", "salt", "cls", "head", body.alias("body")))
    cold, hot = classes.where(~F.col("hot")), classes.where("hot")
    return _cold_groups(cold).unionByName(_hot_groups(hot))


def _best() -> list:
    """The order in which the first of equal texts stays."""
    return [F.col("n").desc(), F.col("doc_id").asc_nulls_last()]


def _hot(hashed: DataFrame, ranges: int) -> DataFrame:
    """Hashes of texts with more rows than their share, and how many parts to deal each into.

    At most ranges * HOT_SHARE rows: that many shares make up the whole table. So it can be broadcast.
    """
    counted = checkpointed(hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("n_rows")))
    share = hot_share(counted.agg(F.sum("n_rows")).first()[0] or 0, ranges)
    return counted.where(F.col("n_rows") > share).select("hash", F.ceil(F.col("n_rows") / share).cast("int").alias("parts"))


def _numbered(df: DataFrame, by_content: WindowSpec) -> DataFrame:
    """Adds head (the body differs from its neighbour's before it) and cls, the number of heads so far."""
    df = df.withColumn("head", ~F.lag("body").over(by_content).eqNullSafe(F.col("body")))
    return df.withColumn("cls", F.sum(F.col("head").cast("long")).over(by_content.rowsBetween(Window.unboundedPreceding, 0)))


def _result(keep_id: str, size: str) -> list:
    return ["doc_id", F.col(keep_id).alias("keep_id"), F.col(size).alias("group_size"), F.col("doc_id").eqNullSafe(F.col(keep_id)).alias("kept"), F.col("sha").alias("text_sha256")]


def _cold_groups(cold: DataFrame) -> DataFrame:
    """Groups that lie in one range whole: the first row of each, and its size, of a bounded number of narrow rows."""
    group = Window.partitionBy("sha", "cls")
    return cold.select("doc_id", "sha", F.first("doc_id").over(group.orderBy(*_best())).alias("first_id"), F.count(F.lit(1)).over(group).alias("size")).select(*_result("first_id", "size"))


def _hot_groups(hot: DataFrame) -> DataFrame:
    """Groups that were dealt into parts: the heads of the parts are compared in full, then joined back by broadcast.

    There are at most 2 * ranges * HOT_SHARE heads, barring digest collisions.
    """
    sizes = hot.groupBy("sha", "salt", "cls").agg(F.count(F.lit(1)).alias("part"))
    heads = hot.where("head").select("sha", "salt", F.col("cls").alias("part_cls"), "n", "doc_id", "body")
    whole = _numbered(heads, Window.partitionBy("sha").orderBy("body", *_best()))
    whole = whole.withColumn("first_id", F.first("doc_id").over(Window.partitionBy("sha", "cls").orderBy(*_best())))
    parts = whole.select("sha", "salt", F.col("part_cls"), F.col("cls").alias("group"), "first_id")
    parts = parts.join(sizes.withColumnRenamed("cls", "part_cls"), ["sha", "salt", "part_cls"])
    parts = parts.withColumn("size", F.sum("part").over(Window.partitionBy("sha", "group"))).select("sha", "salt", F.col("part_cls").alias("cls"), "first_id", "size")
    return hot.select("doc_id", "sha", "salt", "cls").join(F.broadcast(parts), ["sha", "salt", "cls"]).select(*_result("first_id", "size"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows that stay, with all their columns: one of each group, also of rows that repeat an id and a text.

    Null and empty texts are one group. Ties, repeated rows and null ids are as in exact_dedup; of repeats of the row
    that stays, any one is kept. Column names may be any; an empty table gives an empty result.
    """
    found = exact_dedup(docs, id_col, text_col).groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("repeats"))
    found = found.where(~F.col("stays") | (F.col("repeats") > 1))
    marks = checkpointed(found.groupBy("doc_id").agg(F.collect_list(F.struct("text_sha256", "stays")).alias("marks")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("own_id"))
    joined = rows.join(marks.hint("shuffle_hash"), F.col("own_id").eqNullSafe(F.col("doc_id")), "left")
    own = F.sha2(squeezed(F.coalesce(F.col("row").getField(text_col), F.lit(""))), 256)
    verdict = F.get(F.filter("marks", lambda m: m["text_sha256"] == own)["stays"], F.lit(0))
    joined = joined.withColumn("once", F.when(F.col("marks").isNull(), F.lit(None).cast("boolean")).otherwise(verdict))
    once = joined.where("once").withColumn("sha", own).dropDuplicates(["own_id", "sha"])
    return joined.where("once is null").select("row.*").unionByName(once.select("row.*"))
