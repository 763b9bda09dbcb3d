"""Secret scans over a ledger of content-addressed blobs.

Every version of a document is addressed by the SHA-256 of its text. The ledger, a Parquet table that grows, lists which
(blob, rule, rule version) have been scanned and what was found. A scan compares addresses first: only texts of blobs
that the ledger lacks under some rule are read by rules, each distinct blob once. What is found is appended to the
ledger, and the ledger's findings are joined back to every document that has the blob. Only addresses move for that; of
the texts, just those whose blob has copies or is partly scanned are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import checkpointed, exists, hot_share, replicated, salted, shared_path, shuffle_partitions, small_batches
from quillrank.llm.row_filter import looked_up
from quillrank.sources.corpus import spread


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches of pattern are leftmost and do not overlap; those whose `group` is shorter than `least` are dropped."""

    kind: str
    version: int
    pattern: str
    flags: int = re.ASCII
    group: int = 0
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}/{self.version}"


#: The base kinds, in the order in which equal starts are listed. A run of hex digits that is too short can't hold one
#: that is long enough, so hex and access ask for the length in the pattern where that finds the same spans.
BASE = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", re.ASCII, 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", re.ASCII, 0, 24),
)
_BEGIN, _END = ("-----%s [A-Z ]*PRIVATE KEY(?: BLOCK)?-----" % x for x in ("BEGIN", "END"))
#: Further kinds, listed after the base ones. pem: from the BEGIN line to the END line, whatever the body holds but five
#: dashes in a row; without an END line, the header lines and runs of 16 and more base64 characters that follow. jwt:
#: three parts, of which the first begins a word. All take time in proportion to the text.
MORE = (
    Rule("pem", 2, _BEGIN + r"(?:(?:[^-]++|-{1,4}(?!-))*+" + _END + r"|(?:\r?\n[A-Za-z][A-Za-z-]*+: [^\n]*+)*+(?:[ \t\r\n]*[A-Za-z0-9+/=]{16,})*)"),
    Rule("jwt", 2, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE
#: What stands in place of a redacted span.
MARK = "[redacted]"
LEDGER = "blob string, rule string, spans array<struct<start:int,end:int>>"


def find(text: str, rules: tuple[Rule, ...] = RULES) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, in code points, end exclusive."""
    return {r.kind: [m.span() for m in re.finditer(r.pattern, text, r.flags) if m.end(r.group) - m.start(r.group) >= r.least] for r in rules}


def _scanned(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows of (blob, text, done): one for each rule that is not done."""

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for blob, text, done in zip(batch["blob"], batch["text"], batch["done"], strict=True):
                left = tuple(r for r in rules if done is None or r.key not in done)
                found = find(text, left)
                out += [(blob, r.key, [{"start": a, "end": b} for a, b in found[r.kind]]) for r in left]
            yield pd.DataFrame(out, columns=["blob", "rule", "spans"])

    return blobs.mapInPandas(scanned, LEDGER)


def scan(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings, ledger): findings has a row per input row: doc_id, blob, spans (array of kind, start, end in order).

    ledger is the path of a table that earlier scans wrote, or where this one shall begin it (None: a new path in the
    shared folder). Blobs that it holds under a rule's present version are not read again. The ledger that is returned
    has a row for each scanned (blob, rule), with an empty array where nothing was found; rows are whole by themselves,
    so a scan that breaks off leaves a valid ledger. Null text counts as empty. Repeated rows and null ids stay; other
    columns are ignored; an empty table gives empty findings.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = ledger or shared_path(spark, "secret-ledger")
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = spread(docs.select(F.col(id_col).alias("doc_id"), text.alias("text")))
    addressed = texts.withColumn("blob", F.sha2("text", 256))
    wanted = [r.key for r in rules]
    paths = checkpointed(addressed.select("doc_id", "blob"))
    present = checkpointed(paths.groupBy("blob").agg(F.count(F.lit(1)).alias("copies")))
    share = hot_share(paths.count(), shuffle_partitions(spark))
    hot = checkpointed(present.where(F.col("copies") > share).select("blob", F.ceil(F.col("copies") / share).cast("int").alias("parts")))

    before = spark.read.schema(LEDGER).parquet(path) if exists(spark, path) else spark.createDataFrame([], LEDGER)
    done = before.where(F.col("rule").isin(wanted)).join(present.select("blob"), "blob", "left_semi").groupBy("blob").agg(F.collect_set("rule").alias("done"))
    known = present.join(done, "blob", "left")
    odd = checkpointed(known.where((F.col("copies") > 1) | F.col("done").isNotNull()).select("blob", "done"))
    # most blobs have one path and are new: these texts are scanned where they are read
    apart, maybe = looked_up(addressed, F.col("blob"), odd.select("blob"))
    open_ = odd.where(F.col("done").isNull() | (F.size("done") < len(wanted)))
    some = maybe.select("blob", "text").groupBy("blob").agg(F.first("text").alias("text"))  # equal for equal blobs
    not_odd = some.join(odd.select("blob"), "blob", "left_anti").withColumn("done", F.lit(None).cast("array<string>"))  # passed by the filter's error
    once = some.join(open_, "blob").unionByName(not_odd)
    alone = apart.select("blob", "text", F.lit(None).cast("array<string>").alias("done"))
    _scanned(alone, rules).unionByName(_scanned(once, rules)).write.mode("append").parquet(path)

    whole = spark.read.schema(LEDGER).parquet(path)
    kinds = F.create_map(*(F.lit(x) for r in rules for x in (r.key, r.kind)))
    ranks = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (r.key, i)))
    hits = whole.where(F.col("rule").isin(wanted) & (F.size("spans") > 0)).join(present.select("blob"), "blob", "left_semi")
    hits = hits.select("blob", "rule", F.explode("spans").alias("span"))
    hits = hits.groupBy("blob").agg(F.array_sort(F.collect_set(F.struct("span.start", ranks[F.col("rule")].alias("rank"), "span.end", kinds[F.col("rule")].alias("kind")))).alias("found"))
    listed = F.transform("found", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    hits = replicated(hits.select("blob", listed.alias("spans")), "blob", hot)
    findings = salted(paths, "blob", hot, F.monotonically_increasing_id()).join(hits, ["blob", "salt"], "left")
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return findings.select("doc_id", "blob", F.coalesce("spans", none).alias("spans")), whole


def digest(findings: DataFrame) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256 and spans as text."""
    base = [r.kind for r in BASE]
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return findings.select("doc_id", *map(of, base), F.sha2(line(F.filter("spans", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def cut_spans(text: str, spans: list[tuple[int, int]], mark: str = MARK) -> str:
    """The text with `mark` in place of each span; overlapping spans are one."""
    out, at = [], 0
    for start, end in sorted(spans):
        if end > at:
            out += [text[at:start], mark] if start >= at else []
            at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows with all their columns, every finding in the text replaced by a mark.

    A null text stays null. Repeated rows, null ids and ties stay as they are; an empty table gives an empty result;
    overlapping findings get one mark. Column names may be any.
    """
    spark = docs.sparkSession
    findings = scan(docs, ledger, rules, id_col, text_col)[0].where(F.size("spans") > 0)
    found = checkpointed(findings.groupBy("blob").agg(F.first("spans").alias("spans"), F.count(F.lit(1)).alias("copies")))  # equal for equal blobs
    share = hot_share(found.agg(F.sum("copies")).first()[0] or 0, shuffle_partitions(spark))
    hot = checkpointed(found.where(F.col("copies") > share).select("blob", F.ceil(F.col("copies") / share).cast("int").alias("parts")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("blob"))
    apart, maybe = looked_up(rows, F.col("blob"), found.select("blob"))
    joined = salted(maybe, "blob", hot, F.monotonically_increasing_id()).join(replicated(found.select("blob", "spans"), "blob", hot), ["blob", "salt"], "left")

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else cut_spans(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(texts, spans, strict=True)])

    text = F.col("row").getField(text_col)
    out = joined.select(F.col("row").withField(text_col, cleaned(text, F.col("spans"))).alias("row"))
    return apart.select("row.*").unionByName(out.select("row.*"))
