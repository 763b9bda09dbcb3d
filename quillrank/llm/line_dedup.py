"""Line deduplication across documents, in DataFrame operations only.

Each document is split into lines, and each line with a long enough key gives the key's 128-bit hash. The hashes are
dealt out by range and sorted by document (the largest id first) and position within: one pass over that order numbers
the documents of a key as their first occurrences stream by, so it knows the document that keeps the key and how many
hold it. What goes back to a document is not text but its keep bitmap, run-length compressed: the (start, length) of
each run of zeros, that is of lost lines.

Skew. A key with more than its share of the lines is found by a count of the hashes (combined before the shuffle) and
its documents are dealt into parts, which are ranges and orders of their own. Of each part one narrow row, its number of
documents and its largest id, meets the others'; there is a bounded number of these, and they go back by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.llm.common import BLANKS, ascii_lower, checkpointed, hot_share, shuffle_partitions

#: Code points that a line's key has at least, and documents that hold it.
LEAST_CHARS, LEAST_DOCS = 20, 3


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """For each document that loses lines: doc_id, text_hash and lost, its keep bitmap's runs of zeros in order.

    text_hash tells apart rows that repeat an id with another text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.split(ascii_lower(text), "\n", -1).alias("lines"))
    keys = lines.select("doc_id", "text_hash", F.posexplode("lines").alias("pos", "line")).select("doc_id", "text_hash", "pos", F.btrim("line", F.lit(BLANKS)).alias("key"))
    keys = keys.where(F.char_length("key") >= least_chars).select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    lost = _lost(checkpointed(keys), least_docs, shuffle_partitions(docs.sparkSession))
    return lost.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("zeros")).select("doc_id", "text_hash", _runs(F.col("zeros")).alias("lost"))


def _hot(keys: DataFrame, ranges: int) -> DataFrame:
    """Keys with more lines than their share, and how many parts to deal each into: at most ranges * HOT_SHARE rows."""
    counted = checkpointed(keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_lines")).where(F.col("n_lines") > 1))
    share = hot_share(keys.count(), ranges)
    return counted.where(F.col("n_lines") > share).select("h1", "h2", F.ceil(F.col("n_lines") / share).cast("int").alias("parts"))


def streamed(keys: DataFrame, ranges: int) -> DataFrame:
    """Adds to keys (doc_id, text_hash, pos, h1, h2) what one sorted pass tells: hot, part, nth (the document's number among
    those of the key's part, from the largest id), n_docs and last_id (of the part)."""
    keyed = keys.join(F.broadcast(_hot(keys, ranges)), ["h1", "h2"], "left")
    part = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("parts"))).cast("int")
    dealt = keyed.select("doc_id", "text_hash", "pos", "h1", "h2", F.col("parts").isNotNull().alias("hot"), part.alias("part")).repartitionByRange(ranges, "h1", "h2", "part")
    order = Window.partitionBy("h1", "h2", "part").orderBy(F.desc_nulls_last("doc_id"), "text_hash", "pos")
    first = F.lag(F.lit(1)).over(order).isNull() | ~F.lag("doc_id").over(order).eqNullSafe(F.col("doc_id"))
    nth = F.sum(F.col("first").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = dealt.withColumn("first", first).withColumn("nth", nth)
    return found.withColumn("n_docs", F.last("nth").over(every)).withColumn("last_id", F.first("doc_id").over(every))


def _lost(keys: DataFrame, least_docs: int, ranges: int) -> DataFrame:
    """The lines of keys that least_docs documents hold, outside the last of these."""
    rows = streamed(keys, ranges)
    # of other keys than hot ones this pass knows everything, so only the lines that they lose go further
    rows = checkpointed(rows.where(F.col("hot") | ((F.col("n_docs") >= least_docs) & (F.col("nth") > 1))))
    parts = rows.where("hot").groupBy("h1", "h2", "part").agg(F.max("n_docs").alias("n_docs"), F.max("last_id").alias("last_id"))
    whole = parts.groupBy("h1", "h2").agg(F.sum("n_docs").alias("all_docs"), F.max("last_id").alias("all_last")).where(F.col("all_docs") >= least_docs)
    of_hot = rows.where("hot").join(F.broadcast(whole), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("all_last")))
    return rows.where(~F.col("hot")).select("doc_id", "text_hash", "pos").unionByName(of_hot.select("doc_id", "text_hash", "pos"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, text (the lines that stay).

    A line's key is the line without `[\\x20\\x09-\\x0D]` at both ends and with A-Z lower-cased. Keys of at least
    least_chars code points in at least least_docs documents lose all their lines, except in the document with the
    largest id that holds them; there all stay. Null or empty text is one empty line. Rows that repeat an id are one
    document. A null id comes before every other id. Other columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    lost = keep_bitmaps(docs, id_col, text_col, least_chars, least_docs).withColumnsRenamed({"doc_id": "lost_id", "text_hash": "lost_hash"})
    both = own.join(lost.hint("shuffle_hash"), (F.col("text_hash") == F.col("lost_hash")) & F.col("doc_id").eqNullSafe(F.col("lost_id")), "left")
    lines = F.split("text", "\n", -1)
    return both.select(
        "doc_id", F.size(lines).cast("long").alias("n_lines"),
        F.when(F.col("lost").isNull(), F.lit(0)).otherwise(F.aggregate("lost", F.lit(0), lambda n, run: n + run["length"])).cast("long").alias("n_dropped"),
        F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(_kept(lines, F.col("lost")), "\n")).alias("text"),
    )


def _runs(zeros: Column) -> Column:
    """Sorted numbers as runs (start, length)."""
    starts = F.filter(zeros, lambda x, i: (i == 0) | (F.get(zeros, i - 1) != x - 1))
    ends = F.filter(zeros, lambda x, i: (i == F.size(zeros) - 1) | (F.get(zeros, i + 1) != x + 1))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("length")))


def _kept(lines: Column, lost: Column) -> Column:
    """The lines between the runs."""
    after = lambda run: run["start"] + run["length"]
    before = F.transform(lost, lambda run, i: F.slice(lines, F.when(i == 0, F.lit(0)).otherwise(after(F.get(lost, i - 1))) + 1, run["start"] - F.when(i == 0, F.lit(0)).otherwise(after(F.get(lost, i - 1)))))
    last = F.slice(lines, after(F.element_at(lost, -1)) + 1, F.size(lines))
    return F.concat(F.flatten(before), last)
