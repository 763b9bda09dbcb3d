"""Best-fit packing of tokenised documents into sequences, with a bounded number of open bins.

Tokens are counted where the texts are; only a row of numbers for each piece moves on. These rows are checkpointed and
dealt out evenly by hash, in as many parts as their tokens ask for. Each part is packed online in the order of the hash,
with a bounded look-ahead: of each BLOCK pieces that arrive, the longer ones are placed first. A fixed number of open
bins stand in a bitset keyed by their free space, a piece goes into the bin it fills most, and when all are open and
none has room, the fullest closes. A part's memory is its open bins and one block, however long it is.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import checkpointed, give_back, small_batches
from quillrank.sources.corpus import spread

#: Tokens of a sequence; the id that ends a document; bins that are open at most; pieces of the look-ahead; sequences
#: that a part fills, about: many times the open bins, which are what it leaves partly filled at its end. A block of no
#: more than twice the open bins keeps its long pieces from closing bins that its short ones would fill.
CAPACITY, END_ID, OPEN_BINS, BLOCK, PART_SEQUENCES = 2048, 0, 256, 512, 6000
#: Texts with such runs of blanks go to the slower encoder, whose pattern matching doesn't recurse.
_LONG_BLANKS = re.compile(r"\s{500}")
_SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=4)
def encoder(json_path: str, ranks_path: str | None):
    """text -> ids, as `tokenizers` gives them for json_path with add_special_tokens=False.

    ranks_path is the same vocabulary as byte-pair ranks; the byte-pair encoder on it gives the same ids several times
    faster, except that it lacks the special token and recurses on long blanks, so texts with those take the former.
    """
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

    @lru_cache(maxsize=1)
    def slow():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(json_path)

    if not ranks_path:
        return lambda text: slow().encode(text, add_special_tokens=False).ids
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if _SPECIAL in text or _LONG_BLANKS.search(text):
            return slow().encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def cuts(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of n tokens: only longer documents are cut, and then all pieces but the first are full."""
    first = n % capacity
    return [first] * bool(first) + [capacity] * (n // capacity)


class OpenBins:
    """Online best fit. `place` gives the bin and the offset of a piece. `closed` counts bins that closed with room left."""

    def __init__(self, capacity: int = CAPACITY, most: int = OPEN_BINS):
        self.capacity, self.most, self.free, self.open, self.made, self.closed = capacity, most, 0, 0, 0, 0
        self.by_space: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, space: int) -> int:
        bin_ = self.by_space[space].pop()
        if not self.by_space[space]:
            self.free ^= 1 << space
        self.open -= 1
        return bin_

    def _put(self, bin_: int, space: int) -> None:
        if space:
            self.by_space[space].append(bin_)
            self.free |= 1 << space
            self.open += 1

    def place(self, length: int) -> tuple[int, int]:
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(space)
        else:
            if self.open >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
                self.closed += 1
            space, bin_ = self.capacity, self.made
            self.made += 1
        self._put(bin_, space - length)
        return bin_, self.capacity - space


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, paths: tuple[str, str | None] | None = None) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32."""
    small_batches(docs.sparkSession)
    json_path, ranks_path = paths or default_paths()

    def tokenised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(json_path, ranks_path)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.array([*encode(text), END_ID], "<u4")
                start = 0
                for piece, length in enumerate(cuts(len(ids), capacity)):
                    out.append((doc_id, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())))
                    start += length
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
        give_back()

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = spread(rows).mapInPandas(tokenised, "doc_id string, piece int, start long, length long, ids_crc32 long")
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def place_all(lengths: Iterator[np.ndarray], bins: OpenBins, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bin, offset) of each piece, array by array as its block is complete. Blocks don't depend on how arrays are cut."""
    held: list[np.ndarray] = []
    size = 0

    def placed(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.empty((len(own), 2), np.int64)
        for i in np.argsort(-own, kind="stable").tolist():
            out[i] = bins.place(int(own[i]))
        return out[:, 0], out[:, 1]

    for part in lengths:
        held.append(part)
        size += len(part)
        if size >= block:
            whole = np.concatenate(held)
            for at in range(0, size - block + 1, block):
                yield placed(whole[at : at + block])
            held, size = [whole[size - size % block :]], size % block
    if size:
        yield placed(np.concatenate(held))


def best_fit(pieces_: DataFrame, capacity: int = CAPACITY, most_open: int = OPEN_BINS, part_sequences: int = PART_SEQUENCES, block: int = BLOCK) -> DataFrame:
    """Adds sequence_id and offset to rows with a length, none of them over `capacity`."""
    small_batches(pieces_.sparkSession)
    total = pieces_.agg(F.sum("length")).first()[0] or 0
    parts = max(1, round(total / (capacity * part_sequences)))
    names = pieces_.columns

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, waiting = TaskContext.get().partitionId() << 32, []

        def lengths() -> Iterator[np.ndarray]:
            for batch in batches:
                waiting.append(batch)
                yield batch["length"].to_numpy(np.int64)

        for bin_, offset in place_all(lengths(), OpenBins(capacity, most_open), block):
            rows = pd.concat(waiting, ignore_index=True)
            waiting[:] = [rows[len(bin_) :]]
            yield rows[: len(bin_)].assign(sequence_id=base + bin_, offset=offset)

    kind = pieces_.schema["doc_id"].dataType
    by = F.xxhash64("doc_id", "piece")
    dealt = pieces_.repartition(parts, by).sortWithinPartitions(by, "doc_id", "piece", "length", "ids_crc32")
    dealt = dealt.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas has no null in integers
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema)
    return dealt.mapInPandas(packed, f"{schema}, sequence_id long, offset long").withColumn("doc_id", F.col("doc_id").cast(kind)).select(*names, "sequence_id", "offset")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, most_open: int = OPEN_BINS, paths: tuple[str, str | None] | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then id 0; null and empty texts are that id alone. Sequences hold at most `capacity`
    tokens, without gaps from offset 0. Rows that repeat an id are packed as documents of their own; null ids stay;
    other columns are ignored; an empty table gives an empty result.
    """
    return best_fit(checkpointed(pieces(docs, id_col, text_col, capacity, paths)), capacity, most_open)
