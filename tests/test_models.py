"""Golden values, traps and errors of the three models; and an independent plain-Python model on random corpora."""

import math
import random
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest

from quillrank.operators import ranking
from quillrank import BM25L, BM25Okapi, BM25Plus

A = """the quick brown fox jumps over the lazy dog
never gonna give you up never gonna let you down
the answer to life the universe and everything is 42
to be or not to be that is the question
may the force be with you
hello world this is a test document
python is a great programming language
rust is fast and memory safe
machine learning and artificial intelligence
information retrieval and search engines""".split("\n")


def plain(kind, corpus, query, k1=1.5, b=0.75, epsilon=0.25, delta=None):
    """Scores of tokenised documents; None where no term matches."""
    delta = {"okapi": 0, "plus": 1.0, "l": 0.5}[kind] if delta is None else delta
    n, lengths = len(corpus), [len(d) for d in corpus]
    average = sum(lengths) / n
    df = Counter(t for d in corpus for t in set(d))
    raw = {t: math.log((n - f + 0.5) / (f + 0.5)) for t, f in df.items()}
    mean = sum(raw.values()) / len(raw) if raw else 0
    idf = {
        "okapi": lambda t: raw[t] if raw[t] >= 0 else epsilon * mean,
        "plus": lambda t: math.log(n + 1) - math.log(df[t]),
        "l": lambda t: math.log(n + 1) - math.log(df[t] + 0.5),
    }[kind]
    out = []
    for d in corpus:
        tf, score = Counter(d), None
        for t in query:
            if tf[t]:
                length = (1 - b) + b / average * len(d)
                if kind == "okapi":
                    x = idf(t) * (tf[t] * (k1 + 1) / (tf[t] + k1 * length))
                elif kind == "plus":
                    x = idf(t) * ((delta + tf[t] * (k1 + 1)) / (k1 * length + tf[t]))
                else:
                    c = tf[t] / length
                    x = idf(t) * (k1 + 1) * (c + delta) / (k1 + c + delta)
                score = (score or 0.0) + x
        out.append(score)
    return out


def best(scores, n):
    order = sorted(range(len(scores)), key=lambda i: (scores[i] is None, -(scores[i] or 0), i))
    return order[:n]


MODELS = {"okapi": BM25Okapi, "plus": BM25Plus, "l": BM25L}


@pytest.fixture(scope="module")
def on_a(spark):
    return {k: m(A, spark=spark) for k, m in MODELS.items()}


def full(n, **values):
    out = np.zeros(n)
    for k, v in values.items():
        out[int(k[1:])] = v
    return out


@pytest.mark.parametrize(
    ("kind", "query", "want"),
    [
        ("okapi", "quick brown fox", dict(_0=5.046471986338)), ("plus", "quick brown fox", dict(_0=9.178150871745)), ("l", "quick brown fox", dict(_0=7.107144185023)),
        ("okapi", "to be or not", dict(_2=1.056702239674, _3=6.329354512897, _4=1.337657044905)),
        ("plus", "to be or not", dict(_2=2.060815663429, _3=11.049226228054, _4=2.608743018551)),
        ("l", "to be or not", dict(_2=1.713637435983, _3=8.915530343310, _4=1.948752241328)),
        ("okapi", "be be", dict(_3=3.141695817521, _4=2.675314089809)), ("plus", "be be", dict(_3=5.251747808873, _4=5.217486037102)),
        ("l", "be be", dict(_3=4.306604243955, _4=3.897504482655)),
    ],
)
def test_golden(on_a, kind, query, want):
    assert np.allclose(on_a[kind].get_scores(query.split()), full(10, **want), atol=1e-9)


def test_floor_ties_and_candidates_with_zero(on_a, spark):
    model = on_a["okapi"]
    assert np.allclose(model.get_scores(["is", "the"]), full(10, _0=0.4911847244, _2=0.4720144619, _3=0.3175219805, _4=0.4019443682), atol=1e-9)
    assert [i for i, _ in model.get_top_n_indices(["is", "the"], 7)] == [0, 2, 4, 3, 5, 6, 7]
    other = BM25Okapi(A, k1=2.0, b=0.5, epsilon=0.1, spark=spark)
    assert np.allclose(other.get_scores(["is", "the"]), full(10, _0=0.5233006486, _2=0.5070490757, _3=0.3291729887, _4=0.3924754865), atol=1e-9)


def test_attributes(on_a):
    assert (on_a["okapi"].corpus_size, on_a["okapi"].avgdl, on_a["okapi"].k1, on_a["okapi"].b, on_a["okapi"].epsilon) == (10, 7.4, 1.5, 0.75, 0.25)
    assert (on_a["plus"].delta, on_a["l"].delta) == (1.0, 0.5)


def test_other_golden_corpora(spark):
    b = BM25Okapi(["The quick brown fox jumps over the lazy dog", "Never jump over the lazy dog quickly", "Bright foxes leap over lazy dogs in summer"], spark=spark)
    assert np.allclose(b.get_scores(["quick", "lazy"]), [0.507670086730, 0.026914866588, 0.025400905343], atol=1e-9)
    assert [i for i, _ in b.get_top_n_indices(["over", "lazy"], 2)] == [1, 2]
    c = BM25L(["Data science is an interdisciplinary field", "Machine learning is a subset of data science", "Artificial intelligence and data science are closely related"], spark=spark)
    assert np.allclose(c.get_scores(["data", "science"]), [0.350519905639, 0.326571340658, 0.326571340658], atol=1e-9)
    assert [i for i, _ in c.get_top_n_indices(["data", "science"], 3)] == [0, 1, 2]
    d = BM25Plus(["Natural language processing enables computers to understand human language", "Deep learning empowers natural language processing", "Understanding language is key to AI and machine learning"], spark=spark)
    assert np.allclose(d.get_scores(["language", "learning"]), [0.474119810393, 1.547223610385, 1.300034039495], atol=1e-9)
    e = BM25Okapi(["Hello there good man!", "It is quite windy in London", "How is the weather today?", "This is a longer document with more words to test the implementation", "Short doc"], spark=spark)
    assert np.allclose(e.get_scores(["weather", "today", "london"]), [0, 1.081825343680, 1.171314572477, 0, 0], atol=1e-9)
    assert np.allclose(BM25Okapi(["Test document"], spark=spark).get_scores(["test"]), [-0.274653072167], atol=1e-9)
    assert BM25Okapi(["doc1", "doc2"], spark=spark).get_top_n_indices(["doc1"]) == [(0, 0.0), (1, 0.0)]
    f = BM25Okapi(tokenized_corpus=[["hello", "world"], ["hello", "rust"], ["world", "bm25"]], spark=spark)
    assert [i for i, _ in f.get_top_n_indices(["world"], 3)] == [0, 2, 1]


def test_ways_agree(on_a):
    for model in on_a.values():
        query, queries = ["to", "be", "the"], [["to", "be"], [], ["nothing0"], ["the", "the", "fox"]]
        dense = model.get_scores(query)
        assert model.get_scores_chunked(query, 0) == dense == model.get_scores_numpy(query).tolist()
        assert model.get_scores_with_preprocessed(model.preprocess_query(query)) == dense
        assert model.get_batch_scores(query, [9, 3, 3, 0]) == [dense[9], dense[3], dense[3], dense[0]]
        assert model.get_batch_scores(query, []) == []
        assert model.get_scores_batch(queries) == [model.get_scores(q) for q in queries]
        assert model.get_scores_batch([]) == []
        top = model.get_top_n_indices(query, 4)
        assert model.get_top_n(query, A, 4) == [(A[i], s) for i, s in top]
        ranked = model.batch_top_n([query], 4).orderBy("rank").collect()
        assert [(r["doc_id"], r["score"]) for r in ranked] == [x for x in top if x[1]]


def test_batches_shuffle_only_the_best(on_a):
    """Postings are dealt by document and queries are broadcast: what is shuffled has passed a limit for each query."""
    for model in on_a.values():
        plan = model.batch_top_n([["to", "be"], ["the", "the", "fox"], ["is"]], 3)._jdf.queryExecution().executedPlan().toString()
        own = plan[: plan.index("InMemoryTableScan")]
        assert own.count("Exchange hashpartitioning") == 1 and own.index("Exchange hashpartitioning(query_id") < own.index("row_number(), 3, Partial")
        assert "BroadcastHashJoin" in own and "SortMergeJoin" not in own


def test_queries_beyond_the_bound_are_shuffled(on_a, monkeypatch):
    queries = [["to", "be"], ["the", "the", "fox"], ["is"]]
    few = {name: sorted(map(tuple, model.batch_top_n(queries, 3).collect())) for name, model in on_a.items()}
    monkeypatch.setattr(ranking, "MOST_BROADCAST", 2)
    assert few == {name: sorted(map(tuple, model.batch_top_n(queries, 3).collect())) for name, model in on_a.items()}


def test_table_and_row_forms_of_top_n_agree(on_a):
    for model in on_a.values():
        for query in (["is", "the"], ["fox"], [], ["nothing0"]):
            for n in (1, 3, 10, 20):
                table = [(r["doc_id"], r["score"]) for r in model.top_n(query, n).orderBy("rank").collect()]
                assert table == model.get_top_n_indices(query, n)


def test_query_traps(on_a):
    model = on_a["okapi"]
    assert model.get_scores(["Quick"]) == [0.0] * 10
    assert model.get_top_n_indices(["nothing0"], 3) == [(0, 0.0), (1, 0.0), (2, 0.0)]
    assert model.get_top_n_indices(["fox"], 0) == [] and len(model.get_top_n_indices(["fox"], 50)) == 10 and len(model.get_top_n_indices(["fox"], None)) == 5
    assert len(model.preprocess_query(["be", "nothing0", "be"])) == 2
    twice = np.array(model.get_scores(["be", "be"]))
    assert np.allclose(twice, 2 * np.array(model.get_scores(["be"])))
    long_query = [w for text in A for w in text.split()]
    assert np.allclose(model.get_scores(long_query), [s or 0 for s in plain("okapi", [t.split() for t in A], long_query)], atol=1e-9)


def test_negative_scores_stay_before_fillers(spark):
    model = BM25Okapi(["a b", "a c", "a d", "e f"], epsilon=-0.25, spark=spark)
    found = model.get_top_n_indices(["a"], 4)
    assert [i for i, _ in found] == [0, 1, 2, 3] and found[0][1] < 0 == found[3][1]


def test_empty_documents(spark):
    model = BM25Okapi(["", "a b", "", "c"], spark=spark)
    assert model.corpus_size == 4 and model.avgdl == 0.75
    assert model.get_scores(["a"])[0] == 0
    blank = BM25L(["", " "], spark=spark)
    assert blank.avgdl == 0 and blank.get_scores(["a"]) == [0.0, 0.0]


def test_tokenizers(spark):
    model = BM25Okapi(["ab c def", "x y"], lambda t: [w for w in t.split() if len(w) > 1], spark=spark)
    assert model.avgdl == 1.0

    def fails(text):
        raise RuntimeError("no luck")

    with pytest.raises(ValueError, match="Tokenizer failed: no luck"):
        BM25Okapi(["a"], fails, spark=spark)
    with pytest.raises(ValueError, match="Failed to extract tokens"):
        BM25Okapi(["a"], lambda t: (x for x in t), spark=spark)


def test_errors(on_a, spark):
    with pytest.raises(ValueError, match="Corpus size must be greater than zero."):
        BM25Okapi([], spark=spark)
    with pytest.raises(ValueError, match="Provide either corpus or tokenized_corpus, not both."):
        BM25Plus(["a"], tokenized_corpus=[["a"]], spark=spark)
    with pytest.raises(ValueError, match="Either corpus or tokenized_corpus must be provided."):
        BM25L(spark=spark)
    model = on_a["okapi"]
    with pytest.raises(ValueError, match="One or more document IDs are out of range."):
        model.get_batch_scores([], [0, 10])
    with pytest.raises(ValueError, match="The documents given don't match the index corpus!"):
        model.get_top_n(["a"], A[:3])
    for bad in ("fox", [1], 3):
        with pytest.raises(TypeError):
            model.get_scores(bad)
    with pytest.raises(TypeError):
        BM25Okapi("text", spark=spark)
    with pytest.raises(OverflowError):
        model.get_batch_scores(["a"], [-1])
    with pytest.raises(OverflowError):
        model.get_top_n_indices(["a"], -1)


def test_threads_share_a_model(on_a):
    queries = [["fox"], ["be"], ["is", "the"], ["to"]] * 2
    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(on_a["okapi"].get_scores, queries)) == [on_a["okapi"].get_scores(q) for q in queries]


@pytest.mark.parametrize("kind", MODELS)
def test_random_corpora_equal_plain_python(spark, kind):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    corpus = [rng.choices(words, weights=[1 / (i + 1) for i in range(30)], k=rng.choice([0, 1, 5, 40])) for _ in range(60)]
    corpus += corpus[:10]
    parts = spark.createDataFrame([(i, d) for i, d in enumerate(corpus)], "doc_id long, tokens array<string>")
    for split in (1, 7):
        model = MODELS[kind](tokenized_corpus=parts.repartition(split), k1=1.2, b=0.6)
        for _ in range(3):
            query = rng.choices([*words, "unknown"], k=4)
            want = plain(kind, corpus, query, 1.2, 0.6)
            assert np.allclose(model.get_scores(query), [s or 0 for s in want], atol=1e-9)
            assert [i for i, _ in model.get_top_n_indices(query, 65)] == best(want, 65)


def test_table_corpus_with_sparse_ids(spark):
    docs = spark.createDataFrame([(10, "a b"), (7, "b c"), (99, "d")], "doc_id long, text string")
    model = BM25Plus(docs)
    assert [i for i, _ in model.get_top_n_indices(["b"], 3)] == [7, 10, 99]
    assert model.get_batch_scores(["d"], [99, 7])[1] == 0
    with pytest.raises(ValueError, match="out of range"):
        model.get_batch_scores(["d"], [1])
    assert model.get_top_n(["d"], docs, 1)[0][0] == "d"
    with pytest.raises(ValueError, match="null"):
        BM25Plus(spark.createDataFrame([(1, None)], "doc_id long, text string"))


def test_saved_index(on_a, spark, tmp_path):
    on_a["okapi"].save(str(tmp_path / "index"))
    other = BM25Okapi.load(spark, str(tmp_path / "index"))
    assert other.get_scores(["the", "be"]) == on_a["okapi"].get_scores(["the", "be"])
    plan = other.index.postings.where("term in ('the', 'be')")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term" in plan
    assert (other.corpus_size, other.k1, other.epsilon) == (on_a["okapi"].corpus_size, on_a["okapi"].k1, on_a["okapi"].epsilon)
    with pytest.raises(ValueError, match="out of range"):
        other.get_batch_scores(["the"], [other.corpus_size])
    with pytest.raises(ValueError, match="BM25Okapi, not a BM25L"):
        BM25L.load(spark, str(tmp_path / "index"))


def test_saved_index_of_a_keyed_table(spark, tmp_path):
    docs = spark.createDataFrame([(70, "a b"), (900, "b c c")], "doc_id long, text string")
    BM25Plus(docs, k1=1.1, delta=0.3).save(str(tmp_path / "index"))
    model = BM25Plus.load(spark, str(tmp_path / "index"))
    assert (model.k1, model.b, model.delta) == (1.1, 0.75, 0.3)
    assert [i for i, _ in model.get_top_n_indices(["c"], 2)] == [900, 70]
    assert len(model.get_batch_scores(["b"], [900, 70])) == 2
    with pytest.raises(ValueError, match="out of range"):
        model.get_batch_scores(["b"], [1])
