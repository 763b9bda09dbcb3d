"""URL rules by a blocked Bloom filter with an exact join behind it.

Every rule is a canonical URL (host, path prefix). A page's possible rules are its host's suffixes with the prefixes of
its path that have the length of some rule's path. The blocked Bloom filter drops nearly all possibilities that are not listed; an exact equi-join with the list removes the filter's
false positives. The filter has a fixed largest size, so it can be broadcast whatever the list's length; a longer
list only lets more false positives through to the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm.bloom import build, probe
from quillrank.llm.common import ascii_lower

DEFAULT_VERDICT = "allow"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if the url is null or has no `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict.

    rules has host, path and verdict. A rule fits its host and all subdomains, if the url's path starts with the
    rule's. Of the rules that fit, the longest (host and path together) wins, then the one with the longer host, then
    the smallest verdict. With none, rule is null and the verdict is `default`: what is not listed passes. Null urls
    and urls without `://` have empty parts and fit no rule. Repeated rows and null ids stay; other columns are
    ignored; empty tables, of pages or of rules, work.
    """
    rules = rules.select(ascii_lower(F.col("host")).alias("host"), "path", "verdict").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    sizes = rules.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.length("path")).alias("lengths")).first()
    maybe = probe(build(rules.select(F.xxhash64("host", "path").alias("hash")), sizes["n"]), pages.sparkSession)
    host, path = url_parts(F.coalesce(F.col(url_col), F.lit("")))
    own = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = F.array(*(F.lit(n) for n in sorted(sizes["lengths"]))).cast("array<int>")
    possible = own.distinct().select("page_id", "host", "path", F.explode(suffixes).alias("suffix"), F.length("path").alias("n"))
    possible = possible.select("*", F.explode(F.filter(lengths, lambda n: n <= F.col("n"))).alias("length"))
    possible = possible.select("page_id", "host", "path", "suffix", F.substring("path", F.lit(1), F.col("length")).alias("prefix"))
    possible = possible.where(maybe(F.xxhash64("suffix", "prefix")))
    listed = rules.select(F.col("host").alias("suffix"), F.col("path").alias("prefix"), "verdict")
    length = F.length("suffix") + F.length("prefix")
    fits = possible.join(listed, ["suffix", "prefix"]).groupBy("page_id", "host", "path").agg(
        F.max(F.struct(length.alias("length"), F.length("suffix").alias("host_length"), F.concat("suffix", "prefix").alias("rule"), "verdict")).alias("best")
    )
    fits = fits.select(F.col("page_id").alias("fit_id"), F.col("host").alias("fit_host"), F.col("path").alias("fit_path"), "best")
    on = (F.col("host") == F.col("fit_host")) & (F.col("path") == F.col("fit_path")) & F.col("page_id").eqNullSafe(F.col("fit_id"))
    return own.join(fits, on, "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


#: Fixed values of the registered query: verdict, host and path of each rule.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")
