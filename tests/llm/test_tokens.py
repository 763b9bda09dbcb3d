import random
import zlib

import numpy as np
import pytest

from quillrank.llm import packing, sentencepiece_codec
from tests.llm.cases import awkward, prose, table, whole

public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def ids_of():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def check_packed(rows, found, capacity, ids_of):
    """Every document whole, in order, cut as stated; sequences without gaps."""
    texts = dict(rows)
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for doc_id, parts in by_doc.items():
        ids, at = ids_of(texts[doc_id]), 0
        for piece, r in enumerate(sorted(parts, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (piece, at) and (piece == 0 or r["length"] == capacity)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids) and (len(ids) > capacity or len(parts) == 1)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_pack(spark, ids_of, capacity):
    rows = [r for r in awkward() if r[0] not in (None, 200)]
    rows += [(800, "with <|endoftext|> inside"), (801, "a" + " " * 3000 + "b"), (802, "\n" * 700)]
    used = check_packed(rows, whole(packing.pack(table(spark, rows), capacity=capacity)), capacity, ids_of)
    total = sum(len(ids_of(t)) for _, t in rows)
    assert used <= 1.02 * -(-total // capacity) + 1


def test_pack_repeats_nulls_and_nothing(spark):
    found = whole(packing.pack(table(spark, [(1, "a b"), (1, "a b"), (None, None)])))
    assert sorted((r["doc_id"] or 0, r["length"]) for r in found) == [(0, 1), (1, 3), (1, 3)]
    assert packing.pack(table(spark, [])).count() == 0


def test_open_bins_hold_and_close():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 4, 8, 1, 2)] == [(0, 0), (1, 0), (0, 6), (2, 0), (2, 8), (1, 7)]
    bins = packing.OpenBins(10, 1)
    assert [bins.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (2, 0)]


def test_bins_close_in_pack(spark, ids_of, monkeypatch):
    """More bins would be open at once than may be: some close with room, and every rule of a packing still holds."""
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(1, 60))) for i in range(400)]
    found = whole(packing.pack(table(spark, rows), capacity=64, most_open=3))
    check_packed(rows, found, 64, ids_of)
    lengths = [r["length"] for r in found]
    bins = packing.OpenBins(64, 3)
    made = sum(len(set(b.tolist())) for b, _ in packing.place_all(iter([np.array(lengths)]), bins, 16))
    assert bins.closed > 10 and made >= bins.made >= -(-sum(lengths) // 64)


def test_the_production_bound_binds():
    """Pieces like those of documents: bins close, and the sequences stay within 1.02 of the fewest that hold the tokens."""
    rng = np.random.default_rng(4)
    lengths = np.where(rng.random(30_000) < 0.1, packing.CAPACITY, rng.integers(1, 1500, 30_000))
    bins = packing.OpenBins()
    for part in packing.place_all(iter(np.array_split(lengths, 7)), bins):
        assert len(part[0])
    assert bins.closed > 100 and bins.open <= packing.OPEN_BINS
    assert bins.made <= 1.02 * lengths.sum() / packing.CAPACITY


def test_blocks_do_not_depend_on_batches():
    lengths = np.random.default_rng(5).integers(1, 2048, 5000)
    for parts in (1, 3, 700):
        out = [np.concatenate(c) for c in zip(*packing.place_all(iter(np.array_split(lengths, parts)), packing.OpenBins(), 100), strict=True)]
        first = out if parts == 1 else first
        assert all((a == b).all() for a, b in zip(out, first, strict=True)) and len(out[0]) == 5000


def test_open_bins_equal_a_plain_search():
    rng = random.Random(1)
    bins, plain, closed = packing.OpenBins(50, 5), {}, 0
    for _ in range(3000):
        n = rng.randint(1, 50)
        fits = [s for s in plain.values() if s >= n]
        bin_, offset = bins.place(n)
        if fits:
            assert 50 - offset == min(fits) == plain[bin_]
        else:
            assert offset == 0 and bin_ not in plain
            if len(plain) == 5:
                least = min(plain.values())
                gone = [b for b in plain if plain[b] == least]
                plain.pop(gone[-1] if len(gone) == 1 else next(b for b in reversed(gone) if not any(b in x for x in bins.by_space)))
                closed += 1
            plain[bin_] = 50
        plain[bin_] -= n
        if not plain[bin_]:
            plain.pop(bin_)
        assert len(plain) <= 5
    assert closed


@pytest.fixture(scope="module")
def both():
    import sentencepiece

    path = public.path("piece_bpe_32k.model")
    return sentencepiece_codec.Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)


def test_codec_equals_the_library(both):
    own, library = both
    rng = random.Random(2)
    parts = ["a", "e", "the", " ", "  ", "\n", "s", "ing", "1", "é", "日", "☃", "😀", "aaaa", "--", "==", "//", "▁", "\t", "on", "in", "er", "____", "\x00", "<s>", "　"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(1500)]
    texts += ["x" * 3000, " " * 500, "ab" * 2000, prose(rng, 3000)]
    assert [x.tolist() for x in own.encode_all(texts)] == library.encode(texts)
    for text in texts:
        assert own.decode(own.encode(text)) == text.replace("▁", " ")
        assert own.decode(own.encode(text)) == library.decode(library.encode(text))


def test_long_cuts_equal_the_library(both, monkeypatch):
    own, library = both
    rng = random.Random(5)
    letters = "etaoinshrdlu"
    texts = ["".join(rng.choices(letters, k=20_000)), "日本語の文章" * 3000, "ab☃" * 4000, "x" * 20_001]
    expected = library.encode(texts)
    assert [x.tolist() for x in own.encode_all(texts)] == expected
    for few in (0, 2, 1000):  # edge by edge or by arrays, whatever the cuts' number
        monkeypatch.setattr(sentencepiece_codec, "FEW", few)
        own.remembered.clear()
        short = [t[:300] for t in texts] + [prose(rng, 200)]
        assert [x.tolist() for x in own.encode_all(short)] == library.encode(short)


def test_fit_of_one_pair_equals_fits(both):
    own, _ = both
    rng = np.random.default_rng(4)
    a, b = rng.choice(own.reachable, (2, 5000))
    assert own._fits(a, b).tolist() == [own._fit(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def test_what_is_remembered_is_bounded(both, monkeypatch):
    own, _ = both
    monkeypatch.setattr(sentencepiece_codec, "REMEMBERED_CHARS", 1000)
    for i in range(5):
        own.encode_all([f"{i}" * 900])
        assert sum(map(len, own.remembered)) <= 1000 + 901


def test_suffix_array():
    rng = np.random.default_rng(1)
    for letters in (2, 300):
        text = rng.integers(0, letters, 500)
        order = sentencepiece_codec.suffix_array(text, 16)
        keys = [tuple(text[i : i + 16].tolist()) for i in order]
        assert keys == sorted(keys) and sorted(order.tolist()) == list(range(500))


def test_encode_table(spark, both):
    import hashlib

    _, library = both
    rows = [r for r in awkward() if r[0] is not None]
    found = whole(sentencepiece_codec.encode(table(spark, rows)))
    got = sorted((r["doc_id"], r["n_ids"], r["ids"], r["decoded_sha256"]) for r in found)
    assert got == sorted((i, len(x := library.encode(t or "")), x, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert sentencepiece_codec.encode(table(spark, [])).count() == 0
    assert whole(sentencepiece_codec.encode(table(spark, [(None, None)])))[0]["ids"] == []
