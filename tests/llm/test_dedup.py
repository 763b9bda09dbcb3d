import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillrank.llm import exact_dedup, line_dedup, ngram_jaccard, suffix_dedup
from quillrank.llm.components import connected
from tests.llm.cases import Groups, awkward, prose, table, whole

BLANK = re.compile(r"[\x20\x09-\x0D]")
sha = lambda b: hashlib.sha256(b).hexdigest()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_repeats(rows):
    seen, out = {}, {}
    for doc_id, text in sorted((r for r in set(rows) if r[0] is not None), key=lambda r: r[0]):
        body = (text or "").encode()
        gone = np.zeros(len(body), bool)
        for p in range(len(body) - 99):
            if seen.setdefault(body[p : p + 100], (doc_id, p)) != (doc_id, p):
                gone[p : p + 100] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
        out[doc_id] = (len(body), int(gone.sum()), spans, sha(bytes(np.frombuffer(body, np.uint8)[~gone])))
    return out


def check_repeats(spark, rows):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in whole(suffix_dedup.remove_repeats(table(spark, rows))) if r["doc_id"] is not None}
    assert got == brute_repeats(rows)


def test_suffix_dedup_awkward_rows(spark):
    rows = awkward()
    check_repeats(spark, rows)
    found = suffix_dedup.remove_repeats(table(spark, rows))
    assert found.count() == len(rows)
    assert {r["n_removed"] for r in whole(found) if r["doc_id"] is None} == {0}


def test_suffix_dedup_periods_and_shared_passages(spark):
    rng = random.Random(4)
    passages = [prose(rng, 30) for _ in range(4)]
    rows = [(i, prose(rng, rng.randint(0, 30)) + rng.choice(passages)[rng.randint(0, 40) :] + prose(rng, 5)) for i in range(60)]
    rows += [(100, "abc" * 300), (101, "x" * 99), (102, "x" * 100), (103, "x" * 400), (104, "cab" * 90), (105, passages[0] * 3)]
    check_repeats(spark, rows)


def test_suffix_dedup_hot_anchors(spark):
    """A passage with different surroundings in most documents, in many small batches."""
    rng = random.Random(5)
    passage = prose(rng, 40)
    rows = [(i, f"{prose(rng, rng.randint(1, 9))} {passage} {prose(rng, rng.randint(1, 9))}") for i in range(150)]
    check_repeats(spark, rows)


def test_suffix_dedup_pieces_of_long_texts():
    rng = random.Random(6)
    body = prose(rng, 400).encode()
    text = np.frombuffer(body, np.uint8)
    starts, n, _, _ = suffix_dedup.runs(text, np.array([0]), np.array([len(body)]))
    assert n.sum() == len(body) - 99 and (np.diff(starts) >= n[:-1]).all()


def test_suffix_family_levels():
    rng = np.random.default_rng(1)
    family, seen, want = suffix_dedup.SuffixFamily(), {}, set()
    batches = [rng.integers(97, 99, rng.integers(100, 400), dtype=np.uint8).tobytes() for _ in range(12)]
    batches[5] = batches[2]
    batches[9] = batches[1][20:] + batches[3]
    for order, doc in enumerate(rng.permutation(12).tolist()):
        body, sizes = batches[doc], np.array([len(batches[doc])])
        at = suffix_dedup.suffix_array(np.frombuffer(body, np.uint8), sizes)
        keys = [body[i : i + 100] for i in at.tolist()]
        assert keys == sorted(keys) and len(at) == len(body) - 99
        family.add(body, sizes, np.array([doc]), np.array([0]))
        assert len(family.levels) <= np.log2(order + 1) + 3
    for doc in range(12):
        for p in range(len(batches[doc]) - 99):
            if seen.setdefault(batches[doc][p : p + 100], (doc, p)) != (doc, p):
                want.add((doc, p))
    got = {(d, s) for docs, starts in family.gone for d, s in zip(docs.tolist(), starts.tolist())}
    assert got == want


@pytest.mark.parametrize("block", [7, 100_000])
def test_suffix_family_in_blocks(monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    test_suffix_family_levels()


def test_levels_arise_in_the_operator(spark):
    """Shared passages in many documents and batches: several levels, matches found across them, and all that there are."""
    rng = random.Random(8)
    passages = [prose(rng, 60) for _ in range(30)]
    rows = [(i, f"{prose(rng, 20)} {rng.choice(passages)[rng.randint(0, 99) :]} {prose(rng, 20)}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    found = whole(suffix_dedup.repeated_windows(docs, 0, array=3_000, range_bytes=1 << 30))
    assert max(r["levels"] for r in found) >= 4
    texts, covered = dict(rows), defaultdict(lambda: np.zeros(2000, bool))
    for r in found:
        covered[r["doc_id"]][r["start"] : r["start"] + r["n"] + 99] = True
    for doc_id, (_, removed, _, _) in brute_repeats(rows).items():
        assert covered[doc_id].sum() == removed and removed < len(texts[doc_id])


def test_suffix_dedup_ids_with_other_texts(spark):
    """Rows that repeat an id with another text are documents of their own; which is earlier follows their texts' hashes."""
    rng = random.Random(9)
    p, t1, t2 = (prose(rng, 25) for _ in range(3))
    rows = [(1, p), (2, f"{t1} {p}"), (2, t2), (3, t2), (3, f"{t2} x"), (3, f"{t2} x"), (-4, t1)]
    hashes = {r["text"]: r["h"] for r in spark.createDataFrame(rows, "i long, text string").selectExpr("text", "xxhash64(text) h").collect()}
    order = sorted(set(rows), key=lambda r: (r[0], hashes[r[1]]))
    want = brute_repeats([(k, t) for k, (_, t) in enumerate(order)])
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in whole(suffix_dedup.remove_repeats(table(spark, rows))))
    assert got == Counter((i, *want[order.index((i, t))]) for i, t in rows)


def brute_exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[BLANK.sub("", text or "")].append((-len(text or ""), doc_id is None, doc_id))
    out = []
    for body, members in groups.items():
        keep = sorted(members, key=lambda m: (m[0], m[1], m[2] or 0))[0][2]
        out += [(i, keep, len(members), i == keep, sha(body.encode())) for _, _, i in members]
    return Counter(out)


def test_exact_dedup(spark, monkeypatch):
    rows = [*awkward(), *[(1000 + i, "hot " * (1 + i % 3) + "\n" * (i % 5)) for i in range(200)], *[(2000 + i, "") for i in range(150)]]
    for least in (64, 3):
        monkeypatch.setattr("quillrank.llm.common.HOT_LEAST", least)
        got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in whole(exact_dedup.exact_dedup(table(spark, rows)))]
        assert Counter(got) == brute_exact(rows)
    docs = table(spark, rows)
    stays = exact_dedup.keep_first(docs)
    assert stays.columns == docs.columns
    left = [(r["doc_id"], r["text"]) for r in whole(stays)]
    bodies = [BLANK.sub("", t or "") for _, t in left]
    assert len(set(bodies)) == len(bodies) and set(bodies) == {BLANK.sub("", t or "") for _, t in rows}


def brute_lines(rows):
    held = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(LOWER)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(doc_id)
    out = Counter()
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        last = lambda k: max((d for d in held[k] if d is not None), default=None)
        kept = [x for x in lines if len(held.get(key(x), ())) < 3 or doc_id == last(key(x))]
        out[doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


def test_line_dedup(spark):
    rows = awkward()
    rows += [(600 + i, "\n".join(["Some long line that everybody has"] * (i % 3) + [f"own {i}"] + ["  some LONG line that everybody has\r"])) for i in range(40)]
    found = line_dedup.line_dedup(table(spark, rows))
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in whole(found)) == brute_lines(rows)
    bitmaps = {r["doc_id"]: r["lost"] for r in whole(line_dedup.keep_bitmaps(table(spark, rows)))}
    assert [tuple(x) for x in bitmaps[602]] == [(0, 2), (3, 1)]


def test_line_dedup_hot_keys(spark, monkeypatch):
    """Parts of hot keys: one document with many of the lines, a null id, a part with one document."""
    monkeypatch.setattr("quillrank.llm.common.HOT_LEAST", 3)
    line, other = "a line in very many of the documents", "A LINE in two and then three documents"
    rows = [(i, "\n".join([line] * (1 + i % 3) + [f"own {i}"])) for i in range(60)] + [(None, line), (70, "\n".join([line] * 200))]
    rows += [(80, other), (81, f" {other}\n{other}"), (82, f"x\n{other.lower()}"), (90, "the third line, in two documents\ny"), (91, "the third line, in two documents")]
    found = line_dedup.line_dedup(table(spark, rows))
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in whole(found)) == brute_lines(rows)


def test_line_dedup_sorts_by_document_and_position(spark):
    """The pass over the ranges needs the secondary sort, and no other shuffle comes between range and pass."""
    keys = spark.createDataFrame([(i % 40, 1, i, i % 7, i % 3) for i in range(300)], "doc_id long, text_hash long, pos int, h1 long, h2 long")
    found = line_dedup.streamed(keys, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    window, sort = plan.index("Window"), plan.index("Sort [h1#")
    assert "doc_id#" in (line := plan[sort : plan.index("\n", sort)]) and "DESC NULLS LAST" in line and "pos#" in line and "part#" in line
    assert window < sort < plan.index("rangepartitioning") and "hashpartitioning" not in plan[: plan.index("rangepartitioning")]
    assert {r["nth"] for r in whole(found)} <= set(range(1, 41))


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    groups = Groups()
    for a, (i, x) in enumerate(sets):
        groups.find(i)
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                groups.join(i, j)
    return Counter((i, len(x), groups.find(i)) for i, x in sets)


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(spark, seed):
    rng = random.Random(seed)
    rows = awkward(seed)
    base = prose(rng, 80).split()
    for i in range(60):  # a family of edited copies, some too far from each other
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(80)] = rng.choice(["x", "y", "z"])
        rows.append((700 + i, " ".join(words)))
    for many, block in ((64, 1500), (8, 12)):
        found = whole(ngram_jaccard.jaccard_components(table(spark, rows), many_docs=many, block=block))
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found if r["doc_id"] is not None) == brute_components(rows)
        assert sorted((r["n_shingles"], r["component_id"]) for r in found if r["doc_id"] is None) == sorted((len(shingles(t)), None) for i, t in rows if i is None)
    left = ngram_jaccard.keep_one(table(spark, rows))
    assert {r["doc_id"] for r in whole(left)} == {c for _, _, c in brute_components(rows)} | {None}


def test_jaccard_ids_with_other_texts(spark):
    """Rows that repeat an id are one node, whatever their texts are."""
    rng = random.Random(3)
    a, b, c = (prose(rng, 60) for _ in range(3))
    near = " ".join([*a.split()[:-1], "zz"])
    rows = [(5, a), (5, b), (3, b), (7, near), (9, c), (9, ""), (9, None), (11, f"{c} y"), (2, "other words")]
    found = whole(ngram_jaccard.jaccard_components(table(spark, rows)))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == brute_components(rows)
    assert {r["component_id"] for r in found if r["doc_id"] in (3, 5, 7)} == {3}


def test_jaccard_groups_that_are_no_families(spark):
    """Many documents that share prefix shingles but mostly don't link, and pairs that share several leaders."""
    rng = random.Random(5)
    common = [prose(rng, 12) for _ in range(6)]
    rows = [(i, " ".join(rng.sample(common, 3) + [prose(rng, rng.randint(0, 9))])) for i in range(120)]
    for block in (1500, 15):
        found = whole(ngram_jaccard.jaccard_components(table(spark, rows), many_docs=8, block=block))
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == brute_components(rows)


def test_connected(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1200)]
    groups = Groups()
    for u, v in links:
        groups.join(u, v)
    found = {r["node"]: r["component"] for r in whole(connected(spark.createDataFrame(links, "u long, v long")))}
    assert found == {x: groups.find(x) for u, v in links if u != v for x in (u, v)}
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("operator", [exact_dedup.exact_dedup, exact_dedup.keep_first, line_dedup.line_dedup, ngram_jaccard.jaccard_components, ngram_jaccard.keep_one, suffix_dedup.remove_repeats])
def test_empty_tables(spark, operator):
    assert operator(table(spark, [])).count() == 0
