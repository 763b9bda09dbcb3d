"""Tokenizers as Column expressions, each with an equal Python form for single texts.

A tokenizer has `column(text)`, which gives an ARRAY<STRING> Column inside code generation, and can be called on a str.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points of the Unicode property White_Space, at which the default tokenizer splits.
WHITE_SPACE = r"\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: What Python's str.split() takes for white space beyond that.
ALSO_IN_PYTHON = r"\x{1C}-\x{1F}"
#: The ASCII punctuation characters.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: The default stop-words.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on",
    "that", "the", "to", "was", "will", "with", "this", "but", "they", "have", "had", "what", "said", "each", "which",
    "their", "time", "if",
)
DEFAULT_PATTERN = r"\b\w+\b"
#: What `\w` takes in Python: letters, numbers and the underscore; no marks or joiners. A run of these is a match of the default pattern.
WORD_CHARACTERS = r"\p{L}\p{N}_"
_JUST_SPACE = re.compile(r"[\t-\r \x85\xa0  -     　]+")


def _words(text: Column, blanks: str) -> Column:
    """Split at runs of blanks; a split leaves empty strings at the edges, which are no words."""
    return F.filter(F.split(text, f"[{blanks}]+"), lambda t: t != "")


@dataclass(frozen=True)
class DefaultTokenizer:
    """Splits at Unicode white space and lower-cases."""

    def column(self, text: Column) -> Column:
        return _words(F.lower(text), WHITE_SPACE)

    def __call__(self, text: str) -> list[str]:
        return [t for t in _JUST_SPACE.split(text.lower()) if t]


@dataclass(frozen=True)
class WhitespaceTokenizer:
    """Splits where str.split() does."""

    lowercase: bool = True

    def column(self, text: Column) -> Column:
        return _words(F.lower(text) if self.lowercase else text, WHITE_SPACE + ALSO_IN_PYTHON)

    def __call__(self, text: str) -> list[str]:
        return (text.lower() if self.lowercase else text).split()


def _found_by_python(pattern: str, lowercase: bool):
    @F.pandas_udf("array<string>")
    def tokens(texts: pd.Series) -> pd.Series:
        found = re.compile(pattern).findall
        return texts.map(lambda t: None if t is None else [x.lower() for x in found(t)] if lowercase else found(t))

    return tokens


@dataclass(frozen=True)
class RegexTokenizer:
    """All matches of a pattern, or of its only group, then lower-cased, as re.findall gives them.

    The default pattern is an expression; other patterns, whose dialect the JVM doesn't share, run in Python on Arrow batches.
    """

    pattern: str = DEFAULT_PATTERN
    lowercase: bool = True

    def __post_init__(self):
        if re.compile(self.pattern).groups > 1:
            raise ValueError("A tokenizer pattern can have one group at most")

    def column(self, text: Column) -> Column:
        if self.pattern == DEFAULT_PATTERN:
            found = F.regexp_extract_all(text, F.lit(f"[{WORD_CHARACTERS}]+"), F.lit(0))
            return F.transform(found, F.lower) if self.lowercase else found
        return _found_by_python(self.pattern, self.lowercase)(text)

    def __call__(self, text: str) -> list[str]:
        found = re.findall(self.pattern, text)
        return [t.lower() for t in found] if self.lowercase else found


@dataclass(frozen=True)
class TextTokenizer:
    """Lower-cases, deletes ASCII punctuation, splits where str.split() does, and leaves out stop-words.

    stopwords: None leaves all words in.
    """

    lowercase: bool = True
    remove_punctuation: bool = True
    stopwords: frozenset[str] | None = None

    def column(self, text: Column) -> Column:
        text = F.lower(text) if self.lowercase else text
        text = F.translate(text, PUNCTUATION, "") if self.remove_punctuation else text
        words = _words(text, WHITE_SPACE + ALSO_IN_PYTHON)
        if not self.stopwords:
            return words
        stop = F.array(*(F.lit(w) for w in sorted(self.stopwords)))
        return F.filter(words, lambda t: ~F.array_contains(stop, t))

    def __call__(self, text: str) -> list[str]:
        text = text.lower() if self.lowercase else text
        if self.remove_punctuation:
            text = text.translate(dict.fromkeys(map(ord, PUNCTUATION)))
        return [t for t in text.split() if not self.stopwords or t not in self.stopwords]


class SimpleTokenizer(TextTokenizer):
    """A TextTokenizer with the usual switches.

    An empty list of stop-words means the default ones, unlike in tokenize_text. min_token_length and max_token_length
    are kept as attributes and have no effect.
    """

    def __init__(
        self, lowercase: bool = True, remove_punctuation: bool = True, remove_stopwords: bool = False,
        stopwords: Iterable[str] | None = None, min_token_length: int = 1, max_token_length: int | None = None,
    ):
        chosen = frozenset(stopwords or STOPWORDS) if remove_stopwords else None
        super().__init__(lowercase, remove_punctuation, chosen)
        object.__setattr__(self, "remove_stopwords", remove_stopwords)
        object.__setattr__(self, "min_token_length", min_token_length)
        object.__setattr__(self, "max_token_length", max_token_length)


def text_tokenizer(lowercase: bool = True, remove_punctuation: bool = True, remove_stopwords: bool = False, stopwords: Iterable[str] | None = None) -> TextTokenizer:
    """The tokenizer behind tokenize_text: an empty list of stop-words removes nothing."""
    chosen = frozenset(STOPWORDS if stopwords is None else stopwords) if remove_stopwords else None
    return TextTokenizer(lowercase, remove_punctuation, chosen)


def tokenize_text(text: str | Column, **options) -> list[str] | Column:
    """Tokens of a text, or of a Column of texts. Options as of text_tokenizer."""
    tokenizer = text_tokenizer(**options)
    return tokenizer.column(text) if isinstance(text, Column) else tokenizer(text)


def create_tokenizer(tokenizer_type: str = "simple", **options) -> Callable:
    """A tokenizer by kind: simple, whitespace (lowercase) or regex (pattern, lowercase)."""
    if tokenizer_type == "simple":
        return SimpleTokenizer(**options)
    if tokenizer_type == "whitespace":
        return WhitespaceTokenizer(options.get("lowercase", True))
    if tokenizer_type == "regex":
        return RegexTokenizer(options.get("pattern", DEFAULT_PATTERN), options.get("lowercase", True))
    raise ValueError(f"Unknown tokenizer type: {tokenizer_type}")
