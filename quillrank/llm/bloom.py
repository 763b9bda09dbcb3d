"""Blocked Bloom filter of 64-bit hashes: blocks of 256 bits, one bit in each of a block's eight words."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.sources.shipping import ship

#: Bits for each key, and the filter's largest size.
BITS_PER_KEY, MOST_BYTES = 16, 1 << 25
#: Odd multipliers that choose one bit in each word of a block, derived from a fixed seed.
_SALTS = np.random.default_rng(7).integers(1, 1 << 31, 8, dtype=np.int64) * 2 + 1


def block_count(n_keys: int) -> int:
    return int(np.clip(n_keys * BITS_PER_KEY // 256 + 1, 1, MOST_BYTES // 32))


def _place(hashes: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each hash: its block, and its eight bits as one mask for each word."""
    h = hashes.view(np.uint64)
    block = ((h >> np.uint64(32)) * np.uint64(n_blocks)) >> np.uint64(32)
    low = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    bit = (low[:, None] * _SALTS.astype(np.uint32)[None, :]) >> np.uint32(27)
    return block.astype(np.int64), np.uint32(1) << bit


def build(hashes: DataFrame, n_keys: int) -> np.ndarray:
    """The filter of a one-column DataFrame of hashes, as words (n_blocks, 8); parts are combined by block."""
    ship(hashes.sparkSession)
    n_blocks = block_count(n_keys)

    def parts(batches):
        words = np.zeros((0, 8), np.uint32)
        for batch in batches:
            if not len(words):
                words = np.zeros((n_blocks, 8), np.uint32)
            block, masks = _place(batch.iloc[:, 0].to_numpy(), n_blocks)
            np.bitwise_or.at(words, block, masks)
        full = np.flatnonzero(words.any(axis=1))
        yield pd.DataFrame({"block": full} | {f"w{i}": words[full, i].astype(np.int64) for i in range(8)})

    schema = "block long, " + ", ".join(f"w{i} long" for i in range(8))
    whole = hashes.mapInPandas(parts, schema).groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)))
    out = np.zeros((n_blocks, 8), np.uint32)
    rows = whole.toPandas()  # at most MOST_BYTES / 32 rows
    out[rows["block"].to_numpy(np.int64)] = rows[[f"w{i}" for i in range(8)]].to_numpy(np.uint32)
    return out


def maybe_listed(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """False: certainly not listed."""
    block, masks = _place(hashes, len(words))
    return ((words[block] & masks) == masks).all(axis=1)


def probe(words: np.ndarray, spark):
    """A Column function: may the hash be in the filter? The filter is broadcast; its size is bounded."""
    ship(spark)
    shared = spark.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def maybe(hashes: pd.Series) -> pd.Series:
        return pd.Series(maybe_listed(shared.value, hashes.to_numpy()))

    return maybe
