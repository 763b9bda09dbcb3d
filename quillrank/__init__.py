"""Ranked text retrieval and corpus preparation on Spark DataFrames.

Names are imported when they are first used, so Python workers load only what they run.
"""

from importlib import import_module

_HOME = {
    "quillrank.plans.models": ("BM25L", "BM25Okapi", "BM25Plus", "PreprocessedQuery", "PyPreprocessedQuery"),
    "quillrank.plans.benchmarks": ("benchmark_bm25",),
    "quillrank.functions.tokenizers": ("SimpleTokenizer", "create_tokenizer", "tokenize_text"),
    "quillrank.sources.corpus": ("preprocess_corpus", "validate_corpus", "validate_query"),
}
__all__ = [name for names in _HOME.values() for name in names]
__version__ = "0.1.0"


def __getattr__(name: str):
    for module, names in _HOME.items():
        if name in names:
            return getattr(import_module(module), name)
    raise AttributeError(name)
