"""Statistics of whole texts: the exact counts that rules are stated in, and features for the trained models."""

from __future__ import annotations

from collections import Counter

import numpy as np

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Names of `features`, in order.
FEATURES = (
    "log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "top_word_share", "line_words",
    "upper_share", "digit_share", "stop_share", "pipe_share", "other_share", "longest_word", "short_line_share", "adjacent_share",
)


def counts(text: str) -> tuple[dict[str, int], list[bytes], list[str]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; also the words and the lines."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at exactly the six ASCII blanks
    lines = text.split("\n")
    word_chars = len(text) - sum(map(text.count, " \t\n\x0b\f\r"))
    filled = [x for x in lines if x.strip(" \t\n\x0b\f\r")]
    found = {
        "n_words": len(words),
        "word_chars": word_chars,
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": len(filled) - len(set(filled)),
        "n_repeat_words": repeat_words(words),
    }
    return found, words, filled


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text has twice or more, first ones included."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == n:
        return 0
    times = Counter(windows)
    starts = np.fromiter((times[w] > 1 for w in windows), bool, n)
    covered = np.zeros(n + 2, bool)
    for i in range(3):
        covered[i : n + i] |= starts
    return int(covered.sum())


def features(text: str, found: dict[str, int], words: list[bytes], lines: list[str]) -> list[float]:
    """Numbers that describe a text, without its language, source or id. Texts without words give zeros."""
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars, times = max(1, found["word_chars"]), Counter(words)
    upper, digits = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")), sum(map(text.count, "0123456789"))
    return [
        np.log1p(n), chars / n, found["n_symbols"] / chars, found["n_dup_lines"] / max(1, len(lines)), found["n_repeat_words"] / n,
        (len(times) / n) * np.log1p(n), max(times.values()) / n, n / max(1, len(lines)),
        upper / chars, digits / chars, sum(c for w, c in times.items() if len(w) <= 3) / n, text.count("|") / n,
        sum(map(text.count, "{}[]\\^~_=+@")) / chars, np.log1p(max(map(len, times))), sum(len(x) < 30 for x in lines) / max(1, len(lines)),
        sum(map(bytes.__eq__, words, words[1:])) / n,
    ]
