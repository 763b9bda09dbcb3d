"""Small tables with awkward rows, and a plain union-find."""

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, hash string, kept string, blob string, tokens string"
WORDS = [f"{a}{b}" for a in "ka lo mi su te ro".split() for b in "na ri so tu ve".split()]


def table(spark: SparkSession, rows, schema: str = SCHEMA) -> DataFrame:
    """rows of (doc_id, text); the extra columns have names that operators use inside."""
    full = [(i, t, "en", "src0", None if t is None else len(t), 7, "h", "k", "b", "t") for i, t in rows]
    return spark.createDataFrame(full, schema).repartition(3)


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choices(WORDS, k=n))


def awkward(seed: int = 1) -> list[tuple[int | None, str | None]]:
    """Nulls, empties, blanks, ties, copies, near copies, repeated lines, a very long text, several scripts."""
    rng = random.Random(seed)
    base = [prose(rng, rng.choice([1, 4, 5, 6, 30, 120])) for _ in range(25)]
    line = "A line that Many documents share, of enough length"
    rows: list[tuple[int | None, str | None]] = [(i * 3, t) for i, t in enumerate(base)]
    rows += [(200 + i, t) for i, t in enumerate(base[:8])]
    rows += [(300 + i, t + " " + prose(rng, 3)) for i, t in enumerate(base)]
    rows += [(400 + i, f"{prose(rng, 20)}\n  {line.upper() if i % 2 else line}\t\n{line}\n{prose(rng, 9)}") for i in range(7)]
    rows += [(500, None), (501, ""), (502, " \t\n\x0b\f\r"), (503, "É ü 日本 😀 " * 20), (504, "x" * 5000), (505, "ab" * 400 + "\n" * 300), (506, "\x00\x00 a\x00"), (507, "one two three four"), (508, "ONE two  three\nfour"), (509, " no-break blank")]
    rows += [(510, prose(rng, 60_000))]
    rows += [(None, base[0]), (None, "null id"), (200, base[0])]
    return rows


def whole(frame) -> list[dict]:
    return [r.asDict() for r in frame.collect()]


class Groups:
    def __init__(self):
        self.of = {}

    def find(self, x):
        self.of.setdefault(x, x)
        while self.of[x] != x:
            x = self.of[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.of[max(a, b)] = min(a, b)
