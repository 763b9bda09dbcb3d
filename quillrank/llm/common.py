"""Helpers shared by the operators: blanks, the shared folder, joins with hot keys, numbers of documents."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.sources.shipping import ship

_LIBC = ctypes.CDLL(None)
#: The six ASCII blanks, `[\x20\x09-\x0D]`.
BLANKS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def squeezed(text: Column) -> Column:
    """The text without its ASCII blanks."""
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset on a single machine, a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="checkpoints-")


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` computed once and cut from its lineage, in the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, for a table that several jobs read."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _at(spark, path)
    return files.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    where, files = _at(spark, path)
    files.delete(where, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes that go to a Python worker at a time, where the session sets no bound of its own: whole texts are large.
BATCH_BYTES = 2_000_000


def give_back() -> None:
    """Returns freed memory of a Python worker to the system: workers stay for later stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Readies a session for Python stages over texts: the package is on the executors, and batches are bounded in bytes.

    The bound is a setting of the session, as Spark has no other place for it; it never changes a result, and a
    setting of the session's own, of bytes or of rows, stays.
    """
    ship(spark)
    own = spark._jsparkSession.sessionState().conf()
    names = [f"spark.sql.execution.arrow.{n}" for n in ("maxBytesPerBatch", "maxRecordsPerBatch")]
    if not any(own.contains(n) for n in names):
        spark.conf.set(names[0], BATCH_BYTES)


#: A key is hot when it holds more rows than a range's share over this; so there are at most ranges * HOT_SHARE hot keys.
HOT_SHARE, HOT_LEAST = 8, 64


def hot_share(n_rows: int, ranges: int) -> int:
    """Rows of a key from which on it is hot: a share of all rows, so the number of hot keys is bounded."""
    return max(HOT_LEAST, n_rows // (ranges * HOT_SHARE))


def salted(rows: DataFrame, key: str, hot: DataFrame, by: Column) -> DataFrame:
    """rows with `salt`: 0, or for a hot key one of its parts, by a hash of `by`. hot: (key, parts), of bounded length."""
    marked = rows.join(F.broadcast(hot), key, "left")
    return marked.withColumn("salt", F.pmod(F.xxhash64(by), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")


def replicated(table: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """A table with a row for each key, and `salt`: a hot key's row once for each of its parts, at most ranges * HOT_SHARE more rows."""
    marked = table.join(F.broadcast(hot), key, "left")
    return marked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")


def joined_by_share(rows: DataFrame, table: DataFrame, key: list[str], size: str, share: int) -> DataFrame:
    """An inner join in which no key's rows meet in one task: table has one row for each key with its number of rows.

    Keys of more than `share` rows (see hot_share: a bounded number) are joined by broadcast, the others by key.
    """
    hot, cold = table.where(F.col(size) > share), table.where(F.col(size) <= share)
    of_hot = rows.join(F.broadcast(hot), key)
    return of_hot.unionByName(rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(cold, key))


@dataclass(frozen=True)
class Survey:
    """Rows, bytes of text, and whether an id comes with different texts."""

    n_rows: int
    n_bytes: int
    repeats: bool


def survey(known: DataFrame) -> Survey:
    """Of rows (doc_id, text); combined by id before the shuffle."""
    print_ = F.xxhash64("text")
    by_id = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b"), F.min(print_).alias("x"), F.max(print_).alias("y"))
    row = by_id.agg(F.sum("n"), F.sum("b"), F.max(F.col("x") != F.col("y"))).first()
    return Survey(row[0] or 0, row[1] or 0, bool(row[2]))


def numbered(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For rows that repeat an id with different texts: rows (own, doc_id, text), and the numbers (own, doc_id).

    own numbers the distinct pairs of id and text, in the order of the id and then of the text's hash. The rows are
    checkpointed, so that they are read again in the same order.
    """
    prints = known.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")
    counted = checkpointed(prints.groupBy("doc_id", "h1", "h2").agg(F.count(F.lit(1)).alias("copies")))
    names = counted.repartitionByRange("doc_id", "h1", "h2").sortWithinPartitions("doc_id", "h1", "h2")
    names = checkpointed(names.withColumn("own", F.monotonically_increasing_id()))
    ranges = shuffle_partitions(known.sparkSession)
    share = hot_share(names.agg(F.sum("copies")).first()[0] or 0, ranges)
    hot = names.where(F.col("copies") > share).select("own", "doc_id", "h1", "h2")  # at most ranges * HOT_SHARE rows
    key = ["doc_id", "h1", "h2"]
    of_hot = prints.join(F.broadcast(hot), key)
    of_cold = prints.join(F.broadcast(hot.select(*key)), key, "left_anti").join(names.select("own", *key), key)
    columns = ["own", "doc_id", "text"]
    return checkpointed(of_hot.select(*columns).unionByName(of_cold.select(*columns))), names.select("own", "doc_id")
