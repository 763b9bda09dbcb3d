import random
import string

from quillrank import BM25Plus, benchmark_bm25
from quillrank.sources.generators import random_corpus, random_documents, random_queries, zipf_corpus


def test_repeatable():
    assert random_corpus(5, 20, 50, seed=1) == random_corpus(5, 20, 50, seed=1) != random_corpus(5, 20, 50, seed=2)
    assert all(len(t.split()) >= 10 for t in zipf_corpus(5, 12, 100, seed=1))
    words = [f"w{i}" for i in range(2000)]
    queries = random_queries(words, 50, seed=4)
    assert queries == random_queries(words, 50, seed=4)
    assert all(2 <= len(q.split()) <= 5 and set(q.split()) <= set(words[:1000]) for q in queries)


def test_documents_on_executors(spark):
    rows = random_documents(spark, 30, 8, 100, zipf=True, seed=5).collect()
    assert len(rows) == 30 and all(len(r["text"].split()) == 8 for r in rows)
    assert rows == random_documents(spark, 30, 8, 100, zipf=True, seed=5).collect()


def test_suite(spark):
    found = benchmark_bm25([50], 60, 5, [BM25Plus], of_thread=2, delta=0.5)
    assert found["query_performance"]["BM25Plus"]["batch"]["queries"] == 5 == found["query_performance"]["BM25Plus"]["single"]["queries"]
    assert found["initialization"]["BM25Plus"][0]["docs"] == 50
    assert found["concurrent_performance"]["BM25Plus"]["threads"] == 4 and found["concurrent_performance"]["BM25Plus"]["queries"] == 8


def test_seeds_give_the_same_words_as_the_module_generator():
    random.seed(9)
    words = ["".join(random.choices(string.ascii_lowercase, k=random.randint(3, 10))) for _ in range(30)]
    text = " ".join(random.choices(words, k=max(10, int(random.normalvariate(20, 6.0)))))
    assert random_corpus(1, 20, 30, seed=9) == [text]
