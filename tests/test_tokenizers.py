import pytest
from pyspark.sql import functions as F

from quillrank import SimpleTokenizer, create_tokenizer, preprocess_corpus, tokenize_text, validate_corpus, validate_query
from quillrank.functions.tokenizers import STOPWORDS, DefaultTokenizer, RegexTokenizer, TextTokenizer, WhitespaceTokenizer, text_tokenizer

TEXTS = [
    "", " ", "The quick, brown fox jumps over the lazy dog!", "a-b c_d e.f", "Éa è　ß x", "x\x1cy z", "ΑΣ İstanbul", "  lead and trail  ",
    "tab\tnew\nline\r\x0b\x0cend", "42 is 42", "“quoted” …", "a\x85b c", "don't stop",
]
#: Combining marks, joiners, Indic vowel signs, numbers that are no digits, and what Java and Python class differently.
TEXTS += ["e\u0301cole E\u0301cole", "a\u200db \u200c c\u200cd", "\u0915\u094d\u0937\u093f \u0928\u092e\u0938\u094d\u0924\u0947", "x\u00b2 \u2460 \u216b \u0663\u0664", "\u203f a\u203fb _a_", "\u00aa\u00ba \u2107", "\U0001d400 \U0001f600a"]
ALL = [DefaultTokenizer(), WhitespaceTokenizer(), WhitespaceTokenizer(False), RegexTokenizer(), RegexTokenizer(r"(\w)\w*", False), RegexTokenizer(r"(?P<x>[^\W\d]+)-?\b"), RegexTokenizer(r"\S+\s"), text_tokenizer(), SimpleTokenizer(remove_stopwords=True), TextTokenizer(False, False)]


@pytest.mark.parametrize("tokenizer", ALL, ids=repr)
def test_column_equals_python(spark, tokenizer):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").select("id", tokenizer.column(F.col("text")).alias("t")).collect()
    assert {r["id"]: r["t"] for r in rows} == {i: tokenizer(t) for i, t in enumerate(TEXTS)}


def test_default_splits_at_unicode_white_space_only():
    assert DefaultTokenizer()("A b　c") == ["a", "b", "c"]
    assert DefaultTokenizer()("a\x1cb") == ["a\x1cb"]
    assert tokenize_text("a\x1cb") == ["a", "b"]


def test_simple_tokenizer():
    text = "The quick, brown fox jumps over the lazy dog!"
    assert SimpleTokenizer(remove_stopwords=True)(text) == "quick brown fox jumps over lazy dog".split()
    assert tokenize_text("a-b") == ["ab"]
    assert tokenize_text("the cat", remove_stopwords=True, stopwords=[]) == ["the", "cat"]
    assert SimpleTokenizer(remove_stopwords=True, stopwords=[])("the cat") == ["cat"]
    assert SimpleTokenizer(min_token_length=3, max_token_length=3)("a bb cccc") == ["a", "bb", "cccc"]
    assert tokenize_text("The THE", lowercase=False, remove_stopwords=True) == ["The", "THE"]
    assert len(set(STOPWORDS)) == len(STOPWORDS) == 36


def test_factory():
    assert create_tokenizer()("A, b") == ["a", "b"]
    assert create_tokenizer("whitespace", lowercase=False)("A, b") == ["A,", "b"]
    assert create_tokenizer("regex", pattern=r"\d+")("a1 22") == ["1", "22"]
    with pytest.raises(ValueError, match="Unknown tokenizer type: other"):
        create_tokenizer("other")


def test_preprocess_corpus(spark):
    assert preprocess_corpus(["The Cat.", ""], remove_stopwords=True) == ["cat", ""]
    assert preprocess_corpus(["a b"], lambda t: [t]) == ["a b"]
    docs = spark.createDataFrame([(0, "The Cat.")], "doc_id long, text string")
    assert preprocess_corpus(docs).first()["text"] == "the cat"


@pytest.mark.parametrize(
    ("corpus", "told"),
    [("no list", "Corpus must be a list of strings"), ([], "Corpus cannot be empty"), (["a", 1], "Document at index 1 must be a string"), (["a", " \n"], "Document at index 1 is empty")],
)
def test_validate_corpus(corpus, told):
    with pytest.raises(ValueError, match=told):
        validate_corpus(corpus)
    validate_corpus(["a"])


def test_validate_corpus_table(spark):
    docs = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    validate_corpus(docs("a", "b"))
    with pytest.raises(ValueError, match="Document at index 1 is empty"):
        validate_corpus(docs("a", "　\x1c", None))
    with pytest.raises(ValueError, match="Corpus cannot be empty"):
        validate_corpus(docs("a").limit(0))


@pytest.mark.parametrize(("query", "told"), [("q", "Query must be a list"), ([], "Query cannot be empty"), (["a", 2], "Query term at index 1 must be a string")])
def test_validate_query(query, told):
    with pytest.raises(ValueError, match=told):
        validate_query(query)
    validate_query(["a"])
