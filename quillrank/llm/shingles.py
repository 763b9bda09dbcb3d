"""Hashed word shingles of whole texts."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words in a shingle.
WORDS = 5
#: Odd multipliers of a shingle's words and of the mixing after, from a fixed seed.
_ODD = np.random.default_rng(5).integers(1, 1 << 63, WORDS + 3, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all 64."""
    x = (x ^ (x >> np.uint64(31))) * _ODD[WORDS]
    x = (x ^ (x >> np.uint64(29))) * _ODD[WORDS + 1]
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's 5-word shingles; with fewer words, of the whole sequence.

    Words are what the six ASCII blanks part, with A-Z lower-cased. Texts without words give an empty array.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < WORDS:
        return mixed((hashes * _ODD[: len(words)]).sum(keepdims=True) + np.uint64(len(words)) * _ODD[WORDS + 2])
    n = len(words) - WORDS + 1
    total = hashes[:n] * _ODD[0]
    for i in range(1, WORDS):
        total += hashes[i : n + i] * _ODD[i]
    return np.unique(mixed(total))


def shingle_strings(text: str) -> set[bytes]:
    """The shingles themselves."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) < WORDS:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(WORDS)))))


def fingerprint(found: np.ndarray) -> tuple[int, int]:
    """128 bits, as two signed longs, that equal sets share."""
    both = np.array([found.sum(dtype=np.uint64), mixed(found ^ _ODD[0]).sum(dtype=np.uint64)], np.uint64)
    return tuple(both.view(np.int64).tolist())
