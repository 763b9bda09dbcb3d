import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrank.llm import boosted_trees, quality_classifier, quality_rules
from quillrank.llm.statistics import FEATURES, counts, features
from tests.llm.cases import awkward, prose, table, whole

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    words = WORD.findall(text or "")
    times = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if times[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered))


def samples(rng, n=240):
    """Prose (label 1) and junk of three kinds (label 0)."""
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        words = prose(rng, rng.randint(60, 150)).split()
        if not good:
            kind = i % 3
            words = [w + rng.choice(["***", "%%%"]) for w in words] if kind == 0 else [" | ".join(words)] if kind == 1 else [w for w in words[:9] for _ in range(15)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(good), 0))
    return rows, labels


@pytest.fixture(scope="module")
def labelled(spark):
    rows, labels = samples(random.Random(1))
    return table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((i, q) for i, q, _ in labels)


def test_rules(spark, labelled):
    docs, labels, truth = labelled
    trees = quality_rules.fit(docs, labels)
    found = {r["doc_id"]: r for r in whole(quality_rules.quality_rules(docs, trees))}
    wrong = sum(found[i]["kept"] != bool(q) for i, q in truth.items())
    assert wrong <= 2
    rows = awkward()
    got = Counter(tuple(r[k] for k in ("doc_id", *quality_rules.COUNTS, "base_failed")) for r in whole(quality_rules.quality_rules(table(spark, rows), trees)))
    want = Counter((i, *(c := brute_counts(t)), c[0] < 50 or 100 * c[4] > 50 * c[0]) for i, t in rows)
    assert got == want
    kept = quality_rules.keep_good(docs, trees)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in whole(kept)} == {i for i, r in found.items() if r["kept"]}


def test_trees_are_monotonic_and_exact():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=600) > 0).astype(float)
    trees = boosted_trees.train(x, y, np.array([1, -1, 0]))
    assert ((trees.probability(x) > 0.5) == y).mean() > 0.93
    for j, sign in ((0, 1), (1, -1)):
        grid = np.repeat(x[:50], 40, 0)
        grid[:, j] = np.tile(np.linspace(-3, 3, 40), 50)
        assert (sign * np.diff(trees.margin(grid).reshape(50, 40), axis=1) >= -1e-12).all()
    assert np.allclose(boosted_trees.train(x[:0], y[:0], np.zeros(3)).probability(x[:2]), 0.5)


def test_classifier(spark, labelled):
    docs, labels, truth = labelled
    model = quality_classifier.fit(docs, labels)
    found = {r["doc_id"]: r for r in whole(quality_classifier.quality_scores(docs, model))}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    held = [i for i, r in found.items() if r["held_out"]]
    assert sum(found[i]["predicted"] != truth[i] for i in held) <= 1
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in found.values())
    rows = awkward()
    scored = whole(quality_classifier.quality_scores(table(spark, rows), model))
    assert len(scored) == len(rows) and all(r["score"] is not None for r in scored)


def test_classifier_is_the_plain_logistic_fit():
    """Weights against a plain descent on the same pairs, scores against the formulas written out row by row."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=300) > 0).astype(int)
    model = quality_classifier.fit_pairs(x, y)
    draw = np.random.default_rng(quality_classifier.SEED)
    z = np.array([[f for part in (lambda t: t, lambda t: max(t - 0.5, 0), lambda t: max(-0.5 - t, 0)) for f in map(part, np.clip((row - x.mean(0)) / x.std(0), -6, 6))] for row in x])
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    diffs = z[draw.choice(good, quality_classifier.MOST_PAIRS)] - z[draw.choice(bad, quality_classifier.MOST_PAIRS)]
    w, before = np.zeros(6), np.zeros(6)
    steepest = len(diffs) / 4 * np.linalg.eigvalsh(diffs.T @ diffs / len(diffs)).max() + 3.0
    for k in range(3000):  # accelerated descent; the loss is convex: sum of log(1 + exp(-d.w)) + 3 |w|^2 / 2
        at = w + k / (k + 3) * (w - before)
        w, before = at - (3.0 * at - diffs.T @ (1 / (1 + np.exp(diffs @ at)))) / steepest, w
    assert np.allclose(model.weights, w, atol=2e-3)
    strengths = z @ model.weights
    assert np.allclose(model.strength(x), strengths)
    scores = [1 / (1 + np.exp(-(model.slope * (s - model.cut) + np.log(0.3 / 0.7)))) for s in strengths]
    assert np.allclose(model.score(x), scores) and ((model.score(x) >= 0.3) == (strengths >= model.cut)).all()
    errors = lambda cut: int(((strengths >= cut) != (y == 1)).sum())
    assert errors(model.cut) == min(errors(c) for c in [*strengths, strengths.max() + 1])


def test_verdicts_equal_a_walk_through_each_tree(labelled, spark):
    docs, labels, _ = labelled
    trees = quality_rules.fit(docs, labels)

    def probability(row):
        total = trees.bias
        for node in trees.roots.tolist():
            while trees.feature[node] >= 0:
                node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
            total += trees.value[node]
        return 1 / (1 + np.exp(-total))

    texts = [t or "" for _, t in awkward()] + [t for _, t in samples(random.Random(7), 60)[0]]
    want = [probability(features(t, *counts(t))) for t in texts]
    found = quality_rules.verdicts(texts, trees)
    assert np.allclose(found["probability"], want)
    plain = [not (len(WORD.findall(t)) < 50 or 100 * brute_counts(t)[4] > 50 * len(WORD.findall(t))) and p >= 0.3 for t, p in zip(texts, want, strict=True)]
    assert found["kept"].tolist() == plain and 0 < sum(plain) < len(plain)


def test_classifier_never_sees_held_out_labels(labelled):
    docs, labels, _ = labelled
    turned = labels.withColumn("quality", F.when(quality_classifier.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality_classifier.fit(docs, labels), quality_classifier.fit(docs, turned)
    assert np.allclose(a.weights, b.weights) and a.cut == b.cut


def test_without_two_kinds_of_labels(spark, labelled):
    docs, labels, _ = labelled
    ones = labels.where("quality = 1")
    for chosen in (ones, labels.limit(0)):
        assert {r["score"] for r in whole(quality_classifier.quality_scores(docs, quality_classifier.fit(docs, chosen)))} == {0.5}
        kept = {r["kept"] == (not r["base_failed"]) for r in whole(quality_rules.quality_rules(docs, quality_rules.fit(docs, chosen)))}
        assert kept == {True}


def test_empty_tables(spark, labelled):
    _, labels, _ = labelled
    empty = table(spark, [])
    assert quality_rules.quality_rules(empty, quality_rules.fit(empty, labels)).count() == 0
    assert quality_classifier.quality_scores(empty, quality_classifier.fit(empty, labels)).count() == 0


def test_features_of_odd_texts():
    for text in ("", " \n", "\x00", "é", "a " * 3000, "😀\n" * 9):
        values = features(text, *counts(text))
        assert len(values) == len(FEATURES) and np.isfinite(values).all()


def test_held_out_accuracy_on_the_tables(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_classifier.fit(docs, labels)
    both = quality_classifier.quality_scores(docs, model).where("held_out").join(labels, "doc_id")
    assert both.where("predicted != quality").count() <= 0.1 * both.count()
