"""SentencePiece encoding and decoding by suffix-array matching and relaxation, for byte-pair piece models.

Texts are cut where no piece can span (before blanks, at newlines), and the distinct cuts of a batch are encoded:
their concatenation gets a suffix array, every piece of the vocabulary is binary-searched for its range of
occurrences, the occurrences become edges sorted by position, and the edges are relaxed from left to right.

The models are byte-pair ones, for which the segmentation of largest total score is not the one that SentencePiece
gives. So the relaxation is over validity, which is exact: a segmentation is the one that merging yields if and only if
each two neighbouring pieces are what merging makes of the two together, and every prefix has just one such
segmentation; an edge is kept when it fits the piece that ends where it starts. Pieces of equal score (runs of blanks)
have no such order; cuts with two blanks in a row are merged directly.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import give_back, small_batches
from quillrank.sources.corpus import spread

BLANK = "▁"
#: Code points in one suffix array; cuts that a worker remembers, and their characters; characters of text taken at a time.
BLOCK, REMEMBERED, REMEMBERED_CHARS, AT_A_TIME = 400_000, 300_000, 6_000_000, 2_000_000
#: Cuts that are left at a place, from which on edges are relaxed one by one: an array's overhead is that of some 30 edges.
FEW = 8
_CACHE_BITS = 20
#: A code point that no text has: half of a surrogate pair.
_SEPARATOR = 0xD800


class Codec:
    """A vocabulary with what encoding needs: merges, their inverse, and the pieces in order."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = model.get_piece_size()
        plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(n)]
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if plain[i]}
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes_of = [b"" if not plain[i] else p.replace(BLANK, " ").encode() for i, p in enumerate(self.pieces)]
        for b, i in enumerate(self.byte_ids):
            self.bytes_of[i] = bytes([b])
        self.score = np.array([model.get_score(i) for i in range(n)])
        if any(BLANK in p.lstrip(BLANK) for p in self.ids) or any("\n" in p for p in self.ids):
            raise ValueError("pieces of this model span blanks; texts can't be cut there")
        order = np.lexsort((np.arange(n), -self.score))
        self.rank = np.empty(n, np.int64)  # 0 merges first
        self.rank[order] = np.arange(n)
        self._merges()
        self.remembered: dict[str, bytes] = {}
        self.remembered_chars = 0
        self.cached_pair, self.cached_fit = np.full(1 << _CACHE_BITS, -1, np.int64), np.zeros(1 << _CACHE_BITS, bool)

    def _merges(self) -> None:
        """Pairs of pieces that make a piece, and for each piece the two of its last merge (itself twice: a leaf)."""
        n = len(self.pieces)
        self.left, self.right = np.arange(n), np.arange(n)
        pairs, whole, self.reachable = [], [], []
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    pairs.append(a * n + b)
                    whole.append(i)
        order = np.argsort(pairs)
        self.pairs, self.whole = np.array(pairs, np.int64)[order], np.array(whole, np.int64)[order]
        self.merged_by = dict(zip(pairs, whole, strict=True))
        for p, i in self.ids.items():
            got, last = self.merge(p)
            if got == [i]:
                self.reachable.append(i)
                if last:
                    self.left[i], self.right[i] = last
        self.longest = max(len(self.pieces[i]) for i in self.reachable)
        self._table()

    def merge(self, text: str) -> tuple[list[int], tuple[int, int] | None]:
        """Byte-pair merging outright: always the pair with the best score, leftmost of equals. Also the last merge.

        Characters outside the vocabulary are -1 - code point.
        """
        n = len(self.pieces)
        ids = [self.ids.get(c, -1 - ord(c)) for c in text]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(ids) and ids[i] >= 0 and ids[j] >= 0 and (w := self.merged_by.get(ids[i] * n + ids[j])) is not None:
                heapq.heappush(heap, (-self.score[w], i, ids[i], ids[j]))

        for i in range(len(ids) - 1):
            offer(i)
        gone, last = [False] * len(ids), None
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            last = (a, b)
            ids[i], gone[j], after[i] = self.merged_by[a * n + b], True, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [x for x, dead in zip(ids, gone, strict=True) if not dead], last

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of pieces: merging their joined text gives just these two. Negative ids (none, unknown) fit all."""
        out = np.ones(len(a), bool)
        at = np.flatnonzero((a >= 0) & (b >= 0))
        key = a[at] * len(self.pieces) + b[at]
        slot = (key * 0x9E3779B1 >> 7) & ((1 << _CACHE_BITS) - 1)
        known = self.cached_pair[slot] == key
        out[at[known]] = self.cached_fit[slot[known]]
        new, back = np.unique(key[~known], return_inverse=True)
        found = self._fits(new // len(self.pieces), new % len(self.pieces))
        out[at[~known]] = found[back]
        slot = (new * 0x9E3779B1 >> 7) & ((1 << _CACHE_BITS) - 1)
        self.cached_pair[slot], self.cached_fit[slot] = new, found
        return out

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undoes merges from the last to the first; a merge across the border that would have come before one fails."""
        n, ok, limit = len(self.pieces), np.ones(len(a), bool), np.full(len(a), np.iinfo(np.int64).max)
        live, a, b = np.arange(len(a)), a.copy(), b.copy()
        while len(live):
            x, y = a[live], b[live]
            at = np.minimum(np.searchsorted(self.pairs, x * n + y), len(self.pairs) - 1)
            across = self.pairs[at] == x * n + y
            # merges are ordered by (rank, place): twice the rank, and 1 more for those right of the border
            bad = across & (2 * self.rank[self.whole[at]] < limit[live])
            # of equal pieces' merges the left one comes first, the one across the border next, the right one last
            ok[live[bad]] = False
            leaf_x, leaf_y = self.left[x] == x, self.left[y] == y
            later_x = np.where(leaf_x, -1, 2 * self.rank[x] - 1)
            later_y = np.where(leaf_y, -1, 2 * self.rank[y] + 1)
            done = bad | (leaf_x & leaf_y)
            undo_x = ~done & (later_x > later_y)
            undo_y = ~done & ~undo_x
            limit[live[undo_x]] = later_x[undo_x]
            limit[live[undo_y]] = later_y[undo_y]
            a[live[undo_x]] = self.right[x[undo_x]]
            b[live[undo_y]] = self.left[y[undo_y]]
            live = live[~done]
        return ok

    def _fit(self, a: int, b: int) -> bool:
        """_fits for one pair."""
        n, left, right, rank, limit = len(self.pieces), self.left.data, self.right.data, self.rank.data, np.iinfo(np.int64).max
        while True:
            whole = self.merged_by.get(a * n + b)
            if whole is not None and 2 * rank[whole] < limit:
                return False
            later_a = -1 if left[a] == a else 2 * rank[a] - 1
            later_b = -1 if left[b] == b else 2 * rank[b] + 1
            if later_a > later_b:
                limit, a = later_a, right[a]
            elif later_b >= 0:
                limit, b = later_b, left[b]
            else:
                return True

    def encode(self, text: str) -> list[int]:
        """Ids of a text, as SentencePiece gives them."""
        return self.encode_all([text])[0].tolist()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        cuts = [cut(t) for t in texts]
        if len(self.remembered) > REMEMBERED or self.remembered_chars > REMEMBERED_CHARS:
            self.remembered.clear()
            self.remembered_chars = 0
        new = list(set(chain.from_iterable(cuts)).difference(self.remembered))
        self.remembered_chars += sum(map(len, new))
        at = 0
        while at < len(new):
            block, size = at, 0
            while at < len(new) and (size == 0 or size + len(new[at]) < BLOCK):
                size += len(new[at]) + 1
                at += 1
            self.remembered.update(zip(new[block:at], self._encode_cuts(new[block:at]), strict=True))
        return [np.frombuffer(b"".join(map(self.remembered.__getitem__, own)), np.int32) for own in cuts]

    def _encode_cuts(self, cuts: list[str]) -> list[bytes]:
        """The ids of each cut, as packed 32-bit numbers."""
        out = [b""] * len(cuts)
        rest = []
        for i, c in enumerate(cuts):
            if BLANK * 2 in c:
                out[i] = self._spelled(self.merge(c)[0])
            else:
                rest.append(i)
        for i, ids in zip(rest, self._relaxed([cuts[i] for i in rest]) if rest else (), strict=True):
            out[i] = ids
        return out

    def _spelled(self, ids: list[int]) -> bytes:
        """Unknown characters as the pieces of their bytes."""
        return np.array([j for i in ids for j in ([i] if i >= 0 else [self.byte_ids[b] for b in chr(-1 - i).encode()])], np.int32).tobytes()

    def _relaxed(self, cuts: list[str]) -> list[bytes]:
        text = np.frombuffer(chr(_SEPARATOR).join([*cuts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, cuts), np.int64, len(cuts))
        begin = np.cumsum(sizes + 1) - sizes - 1  # each cut has its separator after it
        start, stop, piece = self._edges(text)
        offset = np.arange(len(text)) - np.repeat(begin, sizes + 1)
        where = offset[start] + stop - start  # where an edge ends within its cut
        order = np.argsort(where.astype(np.uint16) if sizes.max() < 1 << 16 else where, kind="stable")
        start, stop, piece = start[order], stop[order], piece[order]
        bounds = np.searchsorted(where[order], np.arange(1, int(sizes.max()) + 2))
        last = np.full(len(text) + 1, -1, np.int64)  # the piece that ends before a position; -1: none
        came = np.zeros(len(text) + 1, np.int64)
        many = int(np.sort(sizes)[-FEW - 1]) if len(sizes) > FEW else 0  # places up to here are in more than FEW cuts
        for k in range(many):
            s, t, p = (x[bounds[k] : bounds[k + 1]] for x in (start, stop, piece))
            good = self.fits(np.where(offset[s] == 0, -1, last[s]), p)
            last[t[good]], came[t[good]] = p[good], s[good]
        rest = slice(bounds[many], None)
        self._relax_singly(start[rest], stop[rest], piece[rest], offset[start[rest]] == 0, last, came)
        on_path, at = np.zeros(len(text) + 1, bool), begin + sizes
        while len(at):  # all cuts at once, from their ends back
            on_path[at] = True
            at = came[at]
            at = at[offset[at] > 0]
        path = np.flatnonzero(on_path)
        ids, first = last[path], np.searchsorted(path, begin + 1)
        ends = np.append(first[1:], len(path)).tolist()
        packed, first = ids.astype(np.int32).tobytes(), first.tolist()
        out = [packed[4 * a : 4 * b] for a, b in zip(first, ends, strict=True)]
        for i in np.unique(np.searchsorted(begin, path[ids < 0], "left") - 1).tolist():
            out[i] = self._spelled(ids[first[i] : ends[i]].tolist())
        return out

    def _relax_singly(self, start: np.ndarray, stop: np.ndarray, piece: np.ndarray, first: np.ndarray, last: np.ndarray, came: np.ndarray) -> None:
        """The same relaxation edge by edge, by increasing stop within a cut, with the same cache of fits."""
        n, mask = len(self.pieces), (1 << _CACHE_BITS) - 1
        last, came, pair, fit = last.data, came.data, self.cached_pair.data, self.cached_fit.data
        for at in range(0, len(start), BLOCK):
            block = slice(at, at + BLOCK)
            for s, t, p, none in zip(*(x[block].tolist() for x in (start, stop, piece, first)), strict=True):
                before = -1 if none else last[s]
                if before >= 0 and p >= 0:
                    key = before * n + p
                    slot = (key * 0x9E3779B1 >> 7) & mask
                    if pair[slot] != key:
                        pair[slot], fit[slot] = key, self._fit(before, p)
                    if not fit[slot]:
                        continue
                last[t], came[t] = p, s

    def _edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All occurrences of all pieces, as (start, stop, piece); characters outside the vocabulary are -1 - code point."""
        order = suffix_array(text, self.longest)
        low, high = self._ranges(text, order)
        n = high - low
        piece = np.repeat(self._piece_ids, n)
        start = order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        stop = start + np.repeat(self._piece_lengths, n)
        known = np.zeros(len(text), bool)
        known[start[stop - start == 1]] = True
        odd = np.flatnonzero(~known & (text != _SEPARATOR))
        return np.concatenate([start, odd]), np.concatenate([stop, odd + 1]), np.concatenate([piece, -1 - text[odd]])

    def _table(self) -> None:
        """The pieces to search for, as rows of code points."""
        self._piece_ids = np.array(self.reachable, np.int64)
        self._piece_lengths = np.array([len(self.pieces[i]) for i in self.reachable], np.int64)
        self._piece_chars = np.full((len(self.reachable), self.longest), -1, np.int64)
        for k, i in enumerate(self.reachable):
            self._piece_chars[k, : len(self.pieces[i])] = [ord(c) for c in self.pieces[i]]

    def _ranges(self, text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Binary search, a character at a time: the range of suffixes that start with each piece."""
        padded = np.concatenate([text, np.full(self.longest, -1)])
        low, high = np.zeros(len(self._piece_ids), np.int64), np.full(len(self._piece_ids), len(text))
        for d in range(self.longest):
            at = np.flatnonzero((self._piece_lengths > d) & (low < high))
            want = self._piece_chars[at, d]
            bounds = []
            for over in (False, True):
                a, b = low[at].copy(), high[at].copy()
                while (open_ := a < b).any():
                    mid = (a + b) >> 1
                    seen = padded[order[np.minimum(mid, len(order) - 1)] + d]
                    less = open_ & ((seen <= want) if over else (seen < want))
                    a = np.where(less, mid + 1, a)
                    b = np.where(open_ & ~less, mid, b)
                bounds.append(a)
            low[at], high[at] = bounds
        return low, high

    def decode(self, ids) -> str:
        """Text of ids; the blank that encoding puts first is taken off, broken bytes become U+FFFD."""
        found = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return found.removeprefix(" ")


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of what follows them, exact up to `depth` characters; prefix doubling.

    The first keys hold as many characters as fit into 62 bits.
    """
    letters, rank = np.unique(text, return_inverse=True)
    rank, bits = rank.astype(np.int64) + 1, int(len(letters) + 1).bit_length()
    key, k = np.zeros(len(text), np.int64), max(1, min(depth, 62 // bits))
    for d in range(k):
        key <<= bits
        key[: max(0, len(text) - d)] |= rank[d:]
    while True:
        order = np.argsort(key)
        sorted_ = key[order]
        rank = np.empty_like(key)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])]) + 1
        if k >= depth or rank[order[-1]] == len(text):
            return order
        after = np.zeros_like(rank)
        after[:-k] = rank[k:]
        key, k = rank * (len(text) + 1) + after, 2 * k


_CUT = re.compile(f"\n|{BLANK}*[^{BLANK}\n]+|{BLANK}+")


def cut(text: str) -> list[str]:
    """A text with its blanks marked and one put before it, cut before each run of blanks and around newlines."""
    return _CUT.findall(BLANK + text.replace(" ", BLANK)) if text else []


@lru_cache(maxsize=2)
def codec(model_path: str) -> Codec:
    return Codec(model_path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_ids, ids, decoded_sha256 (of the text that the ids decode to).

    Null and empty texts have no ids. Repeated rows and null ids stay; other columns are ignored; an empty table gives
    an empty result. Decoding gives the text back, except that U+2581 in it comes back as a blank.
    """
    small_batches(docs.sparkSession)
    model_path = model_path or default_path()

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(model_path)
        ids, texts, size = [], [], 0

        def done() -> pd.DataFrame:
            coded_ = own.encode_all(texts)
            back = [hashlib.sha256(own.decode(x.tolist()).encode()).hexdigest() for x in coded_]
            return pd.DataFrame({"doc_id": ids, "n_ids": [len(x) for x in coded_], "ids": coded_, "decoded_sha256": back})

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
                if size >= AT_A_TIME:
                    yield done()
                    ids, texts, size = [], [], 0
        if ids:
            yield done()
        ids, texts = [], []
        give_back()

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = spread(rows).mapInPandas(coded, "doc_id string, n_ids long, ids array<int>, decoded_sha256 string")
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))
