"""Removal of long repeated byte strings with a logarithmic family of suffix arrays.

A byte goes if a string of WINDOW bytes covers it that also starts earlier: in a document with a smaller id, or earlier
in the same one. Every removal rests on a comparison of bytes; hashes only say what to compare.

Only suffixes that can match are indexed. Each window is represented by its anchor, the KMER bytes in it with the least
hash; equal windows have equal anchors at the same place, and neighbouring windows mostly share theirs, so a text
falls into runs of windows, one in about 35 bytes. A run's windows lie in its stretch of bytes.

1. Map tasks sort the runs of a batch by anchor and stretch; of stretches that are equal byte by byte all but the
   earliest go. The anchors of the others are sent to the range of anchors that is theirs. Those of one run only match
   nothing. What is left are runs that share an anchor with another one.
2. Their stretches are read again and sent by anchor, equal ones of a batch once. Within a task, each arriving batch
   gets a suffix array (the positions of all its windows, sorted to the depth of a window), is merge-scanned against the
   levels that are there, which finds every match, and becomes a level; levels of about equal size merge, so there are
   logarithmically many.
3. The windows found are joined to the texts, and their union is cut out.

An anchor that many runs of one batch share with different stretches (the rims of a passage that a third of all
documents hold) is hot: most of its windows are unlike any other, and one task must not hold them all. A mark goes to
its range instead of the runs, fingerprints of its windows are dealt out evenly by themselves, and only windows whose
fingerprint comes again go into step 2. There are few different ones of these.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.bloom import build, maybe_listed, probe
from quillrank.llm.common import checkpointed, give_back, numbered, shuffle_partitions, small_batches, survey

#: Bytes of a window and of an anchor.
WINDOW, KMER = 100, 32
#: Different stretches of an anchor in one batch from which on it is hot.
MANY = 64
#: Bytes that are hashed at a time, and bytes of a batch.
CHUNK, BATCH = 1_000_000, 8_000_000
#: Bytes of stretches that one suffix array is made of, and, about, in a range of the second step. A range's levels take
#: ten times its bytes.
ARRAY, RANGE = 400_000, 8_000_000
#: Bytes of text whose anchors a range of the first step holds, about.
ANCHOR_RANGE = 64_000_000
#: Windows that are compared with a level at a time.
BLOCK = 100_000
_LOW = np.uint64((1 << 24) - 1)  # place of an anchor within a chunk
_RNG = np.random.default_rng(3)
_LETTERS = _RNG.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = _RNG.integers(1, 1 << 63, 4, dtype=np.uint64) | np.uint64(1)
_BASES = _RNG.integers(1, 1 << 61, 2, dtype=np.uint64) * np.uint64(8) + np.uint64(5)

_DIRECT, _RUNS, _STRETCHES = 0, 1, 2
_PACKED = "key long, kind int, a binary, b binary, c binary, d binary, e binary"
_PACKED_ARROW = pa.schema([("key", pa.int64()), ("kind", pa.int32()), *((c, pa.binary()) for c in "abcde")])
_FOUND = "doc_id long, start long, n int, status int, anchor long"
_WINDOWS = "doc_id long, start long, n int, levels int"
#: Of a run of windows: gone, to be compared, to be compared by fingerprints.
GONE, OPEN, HOT = 1, 2, 3


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[0]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64, out=out)


class Hashed:
    """Hashes of any stretches of a text, by prefix sums of letter * base ** place modulo 2 ** 64."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, text: np.ndarray, which: int = 0):
        size = len(text) + 1
        up, down = self._powers.get(which, (np.zeros(0), np.zeros(0)))
        if len(up) < size:
            base = int(_BASES[which])
            up, down = (_powers(b, max(size, CHUNK + 4096)) for b in (base, pow(base, -1, 1 << 64)))
            self._powers[which] = up, down
        self.down = down
        self.sums = np.zeros(size, np.uint64)
        np.cumsum(_LETTERS[which][text] * up[: size - 1], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return _mixed((self.sums[start + size] - self.sums[start]) * self.down[start] + np.asarray(size, np.uint64) * _ODD[2])

    def every(self, size: int) -> np.ndarray:
        n = max(0, len(self.sums) - size)
        return _mixed((self.sums[size:] - self.sums[:n]) * self.down[:n] + np.array(size, np.uint64) * _ODD[2])


def _least(x: np.ndarray, span: int) -> np.ndarray:
    """The least of each `span` neighbours, by doubling."""
    have = 1
    while 2 * have <= span:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (span - have)], x[span - have :]) if have < span else x


def runs(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with the same anchor in pieces [begin, end) of a text: start, number, anchor's and stretch's fingerprints."""
    none = np.zeros(0, np.int64)
    if len(text) < WINDOW:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    hashed = Hashed(text)
    grams = hashed.every(KMER)
    anchor = (_least((grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64), WINDOW - KMER + 1) & _LOW).astype(np.int64)
    long_ = end - begin >= WINDOW
    edge = np.zeros(len(anchor) + 2, np.int8)
    np.add.at(edge, begin[long_], 1)
    np.add.at(edge, end[long_] - WINDOW + 1, -1)
    inside = np.cumsum(edge[: len(anchor)]).astype(bool)
    change = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    starts = np.flatnonzero(inside & (change | np.concatenate([[True], ~inside[:-1]])))
    stops = np.flatnonzero(inside & np.concatenate([change[1:] | ~inside[1:], [True]])) + 1
    n = stops - starts
    return starts, n, _mixed(grams[anchor[starts]] ^ _ODD[3]), hashed.of(starts, n + WINDOW - 1)


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane; planes of zeros compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def _whole(planes: bytes, kind=np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(kind).ravel()


def _squashed(sorted_: np.ndarray) -> bytes:
    return _planes(np.diff(sorted_, prepend=np.uint64(0)))


def _restored(planes: bytes) -> np.ndarray:
    return np.cumsum(_whole(planes, np.uint64), dtype=np.uint64)


def _rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["key", "kind", "a", "b", "c", "d", "e"])


def _cuts(shards: int) -> np.ndarray:
    return (np.arange(1, shards, dtype=object) * (1 << 64) // shards).astype(np.uint64)


def _same(*columns: np.ndarray) -> np.ndarray:
    """Rows that equal the row before."""
    return np.concatenate([[False], np.logical_and.reduce([c[1:] == c[:-1] for c in columns])]) if len(columns[0]) else np.zeros(0, bool)


def _later(same: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of rows in order of place within groups: those that start later than their group's first row."""
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
    return same & ((doc != doc[first]) | (start != start[first]))


def _words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number; a view."""
    return np.ndarray((max(0, len(text) - 7),), "<u8", np.ascontiguousarray(text), strides=(1,))


def _equal(text: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Are the stretches of `size` bytes (eight at least) from a and from b on equal, byte by byte?"""
    words, ok = _words_at(text), np.ones(len(a), bool)
    for at in range(0, int(size.max()) if len(size) else 0, 8):
        own = np.minimum(at, size - 8)
        ok &= words[a + own] == words[b + own]
    return ok


#: Places of the words of eight bytes that cover a window, the first one aside.
_WORDS = (*range(8, WINDOW - 8, 8), WINDOW - 8)


def _same_windows(text: np.ndarray, a: np.ndarray, other: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which windows at `a` of text equal those at `b` of other, byte by byte. From the end: windows near in order differ late."""
    words, others, at = _words_at(text), _words_at(other), np.arange(len(a))
    for place in (*reversed(_WORDS), 0):
        at = at[words[a[at] + place] == others[b[at] + place]]
    return at


def _anchored(shards: int):
    """Map side of the first step."""

    def flush(texts: list[np.ndarray], parts: list[tuple], number: int) -> pd.DataFrame:
        anchor, stretch, doc, start, n, at = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((start, doc, stretch, anchor))
        anchor, stretch, doc, start, n, at = (c[order] for c in (anchor, stretch, doc, start, n, at))
        same = _same(anchor, stretch, n)
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
        i = np.flatnonzero(same)
        equal = np.zeros(len(same), bool)
        equal[i] = _equal(np.concatenate(texts), at[i], at[first[i]], n[i] + WINDOW - 1)
        gone = equal & _later(same, doc, start)
        direct = [(doc[gone], start[gone], n[gone], np.full(gone.sum(), GONE), anchor[gone])]
        anchor, doc, start, n = (c[~equal] for c in (anchor, doc, start, n))
        head = ~_same(anchor)
        times = np.diff(np.flatnonzero(head), append=len(head))
        hot = np.repeat(times >= MANY, times)
        direct.append((doc[hot], start[hot], n[hot], np.full(hot.sum(), HOT), anchor[hot]))
        rows = [(-1 - number, _DIRECT, *(_planes(np.concatenate(c).astype(np.int64)) for c in list(zip(*direct, strict=True))[:4]), np.concatenate([x[4] for x in direct]).tobytes())]
        n = np.where(hot, 0, n)  # a mark
        kept = ~hot | head
        anchor, doc, start, n = (c[kept] for c in (anchor, doc, start, n))
        cut = np.concatenate([[0], np.searchsorted(anchor, _cuts(shards)), [len(anchor)]])
        for s in np.flatnonzero(np.diff(cut)).tolist():
            x = slice(cut[s], cut[s + 1])
            rows.append((s, _RUNS, _squashed(anchor[x]), _planes(doc[x]), _planes(start[x]), n[x].astype(np.uint8).tobytes(), b""))
        return _rows(rows)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts: list[np.ndarray] = []
        parts: list[tuple] = []
        size, number = 0, TaskContext.get().partitionId() << 24
        for ids, offsets, text, begin, end in _chunks(batches):
            starts, n, anchor, stretch = runs(text, begin, end)
            piece = np.searchsorted(begin, starts, "right") - 1
            parts.append((anchor, stretch, ids[piece], starts - begin[piece] + offsets[piece], n, starts + size))
            texts.append(text)
            size += len(text)
            if size >= BATCH:
                yield flush(texts, parts, number)
                texts, parts, size, number = [], [], 0, number + 1
                give_back()
        if parts:
            yield flush(texts, parts, number)
        give_back()

    return emit


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, ...]]:
    """Texts joined to chunks of bounded size: ids and offsets of the pieces, the bytes, begins and ends.

    Longer texts are cut into pieces that overlap by a window less one byte, so each window is in one piece.
    """
    ids, offsets, pieces, size = [], [], [], 0

    def chunk():
        sizes = np.array([len(p) for p in pieces], np.int64)
        end = np.cumsum(sizes)
        return np.array(ids, np.int64), np.array(offsets, np.int64), np.frombuffer(b"".join(pieces), np.uint8), end - sizes, end

    for frame in batches:
        for doc_id, text in zip(frame["doc_id"].tolist(), frame["text"], strict=True):
            body = text.encode("utf-8", "surrogatepass")
            for at in range(0, max(0, len(body) - WINDOW + 1), CHUNK):
                piece = body[at : at + CHUNK + WINDOW - 1]
                ids.append(doc_id)
                offsets.append(at)
                pieces.append(piece)
                size += len(piece)
                if size >= CHUNK:
                    yield chunk()
                    ids, offsets, pieces, size = [], [], [], 0
    if pieces:
        yield chunk()


def _shared_runs(frame: pd.DataFrame) -> pd.DataFrame:
    """Reduce side of the first step: a row for each run that is gone, or shares its anchor."""
    if frame["kind"].iloc[0] == _DIRECT:
        columns = [np.concatenate([_whole(x) for x in frame[c]]) for c in "abcd"]
        return pd.DataFrame(dict(zip(("doc_id", "start", "n", "status"), columns, strict=True)) | {"anchor": np.concatenate([np.frombuffer(x, np.int64) for x in frame["e"]])})
    anchor = np.concatenate([_restored(x) for x in frame["a"]])
    doc, start = (np.concatenate([_whole(x) for x in frame[c]]) for c in "bc")
    n = np.concatenate([np.frombuffer(x, np.uint8) for x in frame["d"]]).astype(np.int64)
    order = np.lexsort((start, doc, n > 0, anchor))  # marks first
    anchor, doc, start, n = (c[order] for c in (anchor, doc, start, n))
    fresh = (n > 0) & ~_same(anchor, doc, start, n > 0)  # rows that repeat an id and a text are one document
    group = np.cumsum(~_same(anchor)) - 1
    groups = group[-1] + 1 if len(group) else 0
    marked = np.bincount(group, n == 0, groups) > 0
    kept = fresh & ((np.bincount(group, fresh, groups) > 1) | marked)[group]
    status = np.where(marked[group], HOT, OPEN)
    return pd.DataFrame({"doc_id": doc[kept], "start": start[kept], "n": n[kept], "status": status[kept], "anchor": anchor[kept].view(np.int64)})


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, memoryview, dict[str, np.ndarray]]]:
    """Of rows (doc_id, text, wanted, and maybe again): id, bytes, and the columns of the runs, sorted by start."""
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        lists = {c: batch.column(c) for c in batch.schema.names if c not in ("doc_id", "text")}
        for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
            own = {}
            for name, column in lists.items():
                runs_ = column[i].values
                for field in runs_.type if runs_ is not None else ():
                    own[f"{name}.{field.name}"] = runs_.field(field.name).to_numpy(zero_copy_only=False)
            yield doc_id, memoryview(texts[i].as_buffer()), own


def _printed(shards: int):
    """Fingerprints of hot runs' windows. Those that come again in the batch are settled; of each one, the first is sent."""

    def flush(parts: list[tuple], number: int) -> pd.DataFrame:
        one, two, doc, start = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((start, doc, two, one))
        one, two, doc, start = (c[order] for c in (one, two, doc, start))
        fresh = ~_same(one, two, doc, start)
        one, two, doc, start = (c[fresh] for c in (one, two, doc, start))
        same = _same(one, two)
        again = same | np.append(same[1:], False)
        rows = [(-1 - number, _DIRECT, _planes(doc[again]), _planes(start[again]), b"", b"", b"")]
        one, two, doc, start = (c[~same] for c in (one, two, doc, start))
        at = np.concatenate([[0], np.searchsorted(one, _cuts(shards)), [len(one)]])
        for s in np.flatnonzero(np.diff(at)).tolist():
            x = slice(at[s], at[s + 1])
            rows.append((s, _RUNS, _squashed(one[x]), two[x].tobytes(), _planes(doc[x]), _planes(start[x]), b""))
        return _rows(rows)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        size, number = 0, TaskContext.get().partitionId() << 24
        for doc_id, body, own in _bodies(batches):
            for start, n in zip(own["wanted.start"].tolist(), own["wanted.n"].tolist(), strict=True):
                letters = np.frombuffer(body[start : start + n + WINDOW - 1], np.uint8)
                parts.append((Hashed(letters).every(WINDOW), Hashed(letters, 1).every(WINDOW), np.full(n, doc_id), np.arange(start, start + n)))
                size += n
            if size >= BATCH // 8:
                yield pa.RecordBatch.from_pandas(flush(parts, number), _PACKED_ARROW)
                parts, size, number = [], 0, number + 1
        if parts:
            yield pa.RecordBatch.from_pandas(flush(parts, number), _PACKED_ARROW)
        give_back()

    return emit


def _reprinted(frame: pd.DataFrame) -> pd.DataFrame:
    """Windows, as runs, whose fingerprint comes again."""
    if frame["kind"].iloc[0] == _DIRECT:
        return _windows(*(np.concatenate([_whole(x) for x in frame[c]]) for c in "ab"))
    one = np.concatenate([_restored(x) for x in frame["a"]])
    two = np.concatenate([np.frombuffer(x, np.uint64) for x in frame["b"]])
    doc, start = (np.concatenate([_whole(x) for x in frame[c]]) for c in "cd")
    order = np.lexsort((start, doc, two, one))
    one, two, doc, start = (c[order] for c in (one, two, doc, start))
    fresh = ~_same(one, two, doc, start)
    one, two, doc, start = (c[fresh] for c in (one, two, doc, start))
    same = _same(one, two)
    again = same | np.append(same[1:], False)
    return _windows(doc[again], start[again])


def _common_parts(begin: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of intervals [begin, end): their parts inside the union of [a, b), as (which interval, begin, end)."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    head = np.concatenate([[True], a[1:] > b[:-1]]) if len(a) else np.zeros(0, bool)
    a, b = a[head], b[np.append(np.flatnonzero(head)[1:], len(head)) - 1] if len(head) else b
    low, high = np.searchsorted(b, begin, "right"), np.searchsorted(a, end, "left")
    times = np.maximum(0, high - low)
    which = np.repeat(np.arange(len(begin)), times)
    part = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + low[which]
    return which, np.maximum(begin[which], a[part]), np.minimum(end[which], b[part])


def _stretched(shards: int):
    """Map side of the second step: the stretches of open runs, and of the hot runs' windows that come again, by anchor."""

    def flush(held: list[tuple], number: int) -> pd.DataFrame:
        anchor, doc, start = (np.array([x[k] for x in held], np.int64) for k in range(3))
        order = np.lexsort((start, doc))
        first: dict[tuple, int] = {}
        gone, kept = [], []
        for i in order.tolist():
            j = first.setdefault((held[i][0], held[i][3]), i)  # equal stretches of a batch once
            if j == i:
                kept.append(i)
            elif doc[i] != doc[j] or start[i] != start[j]:
                gone.append(i)
        n = np.array([len(held[i][3]) - WINDOW + 1 for i in gone], np.int64)
        rows = [(-1 - number, _DIRECT, _planes(doc[gone]), _planes(start[gone]), _planes(n), b"", b"")]
        shard = np.searchsorted(_cuts(shards), anchor[kept].view(np.uint64), "right")
        by = np.argsort(shard, kind="stable")
        at = np.flatnonzero(np.append(True, np.diff(shard[by]) != 0)) if len(by) else []
        for group in np.split(by, at[1:]) if len(by) else ():
            own = [kept[k] for k in group.tolist()]
            sizes = np.array([len(held[i][3]) for i in own], np.int64)
            body = pa.compress(b"".join(held[i][3] for i in own), "zstd", asbytes=True)  # the shuffle's own codec leaves half as much again
            rows.append((int(shard[group[0]]), _STRETCHES, body, _planes(sizes), _planes(doc[own]), _planes(start[own]), b""))
        return _rows(rows)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, number = 0, TaskContext.get().partitionId() << 24
        for doc_id, body, own in _bodies(batches):
            start, n, status, anchor = (own[f"wanted.{c}"].astype(np.int64) for c in ("start", "n", "status", "anchor"))
            begin, end = start, start + n
            if (hot := status == HOT).any():
                again = [own[f"again.{c}"].astype(np.int64) if f"again.{c}" in own else np.zeros(0, np.int64) for c in ("start", "n")]
                which, a, b = _common_parts(begin[hot], end[hot], again[0], again[0] + again[1])
                begin, end = np.concatenate([begin[~hot], a]), np.concatenate([end[~hot], b])
                anchor = np.concatenate([anchor[~hot], anchor[hot][which]])
            for a, b, key in zip(begin.tolist(), (end + WINDOW - 1).tolist(), anchor.tolist(), strict=True):
                held.append((key, doc_id, a, bytes(body[a:b])))
                size += b - a
            if size >= BATCH:
                yield pa.RecordBatch.from_pandas(flush(held, number), _PACKED_ARROW)
                held, size, number = [], 0, number + 1
        if held:
            yield pa.RecordBatch.from_pandas(flush(held, number), _PACKED_ARROW)
        give_back()

    return emit


def _in_order(windows: np.ndarray) -> np.ndarray:
    """Lexicographic order of the rows: by eight bytes, then eight more where those tie, then in full where rows still differ."""
    first, second = (np.ascontiguousarray(windows[:, i : i + 8]).view(">u8").ravel().astype(np.uint64) for i in (0, 8))
    order = np.argsort(first)
    for keys in (first, first), (first, second):
        tied = _same(*(k[order] for k in (first, keys[1])))
        if keys[1] is first:
            tied[:-1] |= tied[1:]
            at = np.flatnonzero(tied)
            order[at] = order[at][np.lexsort((second[order[at]], first[order[at]]))]
    group = np.cumsum(~tied) - 1
    at = np.flatnonzero(tied)
    differ = np.unique(group[at[(windows[order[at]] != windows[order[at - 1]]).any(axis=1)]])
    at = np.flatnonzero(np.isin(group, differ))
    rows = order[at]
    text = np.ascontiguousarray(windows[rows]).view(f"S{windows.shape[1]}").ravel()
    order[at] = rows[np.lexsort((text, group[at]))]
    return order


@dataclass
class Level:
    """A suffix array: positions in a text of different windows, sorted, each with the earliest place it starts at, and its first word."""

    text: np.ndarray
    at: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.at)

    def words(self, which: slice | np.ndarray, place: int) -> np.ndarray:
        """Eight bytes of each window, as numbers in the order of the bytes."""
        return _words_at(self.text)[self.at[which] + place].byteswap()

    def taken(self, which: np.ndarray) -> Level:
        return Level(self.text, self.at[which], self.doc[which], self.start[which], self.first[which])

    def before(self, key: bytes) -> int:
        """How many windows come before key."""
        low, high = 0, len(self)
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.key(mid) < key else (low, mid)
        return low


def _bound(level: Level, place: int, low: np.ndarray, high: np.ndarray, want: np.ndarray, over: bool) -> np.ndarray:
    """Binary search in many ranges of a level at once, by the word at `place`: the first window not below (over: above) want."""
    low, high, open_ = low.copy(), high.copy(), np.flatnonzero(low < high)
    while len(open_):
        mid = (low[open_] + high[open_]) >> 1
        seen = level.words(mid, place)
        less = seen <= want[open_] if over else seen < want[open_]
        low[open_] = np.where(less, mid + 1, low[open_])
        high[open_] = np.where(less, high[open_], mid)
        open_ = open_[low[open_] < high[open_]]
    return low


def _places(level: Level, new: Level, a: int, b: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For the windows a to b of new: the range of a level's windows with the same first words, narrowed until it holds `least` at most.

    A range that got empty lies where the window belongs.
    """
    mine = new.first[a:b]
    low = np.searchsorted(level.first, mine)
    live = np.flatnonzero(level.first[np.minimum(low, len(level) - 1)] == mine)
    high = low.copy()
    high[live] = np.searchsorted(level.first, mine[live], "right")
    for place in _WORDS:
        live = live[high[live] - low[live] > least]
        want = new.words(a + live, place)
        low[live] = _bound(level, place, low[live], high[live], want, False)
        high[live] = _bound(level, place, low[live], high[live], want, True)
    return low, high


def suffix_array(text: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of the windows of stretches that lie in a text one after the other, sorted."""
    last = np.cumsum(sizes)
    inside = np.ones(max(0, len(text) - WINDOW + 1), bool)
    for back in range(1, WINDOW):
        at = last[:-1] - back
        inside[at[at < len(inside)]] = False
    at = np.flatnonzero(inside)
    if not len(at):
        return at.astype(np.int32)
    return at[_in_order(np.lib.stride_tricks.sliding_window_view(text, WINDOW)[at])].astype(np.int32)


class SuffixFamily:
    """Levels of suffix arrays of geometric sizes. No window is in two of them."""

    def __init__(self):
        self.levels: list[Level] = []
        self.most = 0
        self.gone: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, body: bytes, sizes: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> None:
        """Takes a batch of stretches: finds its matches within itself and with all levels, and makes it a level."""
        text = np.frombuffer(body, np.uint8)
        at = suffix_array(text, sizes)
        begin = np.cumsum(sizes) - sizes
        own = np.repeat(np.arange(len(sizes)), sizes)[at]
        first = _words_at(text)[at].byteswap() if len(at) else np.zeros(0, np.uint64)
        new = self._distinct(Level(text, at, docs[own], starts[own] + at - begin[own], first))
        for level in self.levels:
            new = self._scan(level, new)
        if len(new):
            self.levels.append(new)
        self.most = max(self.most, len(self.levels))
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            self._merge()

    def _distinct(self, new: Level) -> Level:
        same = np.zeros(len(new), bool)
        for a in range(1, len(new), BLOCK):
            b = min(len(new), a + BLOCK)
            same[a + _same_windows(new.text, new.at[a:b], new.text, new.at[a - 1 : b - 1])] = True
        if not same.any():
            return new
        tied = np.flatnonzero(same | np.append(same[1:], False))
        order = np.arange(len(new))
        order[tied] = tied[np.lexsort((new.start[tied], new.doc[tied], np.cumsum(~same[tied])))]
        new = new.taken(order)
        self._gone(_later(same, new.doc, new.start), new.doc, new.start)
        return new.taken(np.flatnonzero(~same))

    def _scan(self, level: Level, new: Level) -> Level:
        """Merge-scan: both are in their order. Returns what of the batch the level lacks."""
        rest = np.ones(len(new), bool)
        for a in range(0, len(new), BLOCK):
            low, high = _places(level, new, a, a + BLOCK, 1)
            one = np.flatnonzero(low < high)
            here, there = a + one, low[one]
            same = _same_windows(new.text, new.at[here], level.text, level.at[there])
            here, there = here[same], there[same]
            doc, start, ldoc, lstart = new.doc[here], new.start[here], level.doc[there], level.start[there]
            sooner = (doc < ldoc) | ((doc == ldoc) & (start < lstart))
            equal = (doc == ldoc) & (start == lstart)
            self._gone(~sooner & ~equal, doc, start)
            self._gone(sooner, ldoc, lstart)
            level.doc[there[sooner]], level.start[there[sooner]] = doc[sooner], start[sooner]
            rest[here] = False
        return new if rest.all() else new.taken(np.flatnonzero(rest))

    def _merge(self) -> None:
        b, a = self.levels.pop(), self.levels.pop()
        place = np.empty(len(b), np.int64)  # how many of a come before each of b
        for at in range(0, len(b), BLOCK):
            place[at : at + BLOCK] = _places(a, b, at, at + BLOCK, 0)[0]
        place += np.arange(len(b))
        from_a = np.ones(len(a) + len(b), bool)
        from_a[place] = False
        out = []
        for x, y in ((a.at, b.at + np.int32(len(a.text))), (a.doc, b.doc), (a.start, b.start), (a.first, b.first)):
            both = np.empty(len(from_a), x.dtype)
            both[from_a], both[place] = x, y
            out.append(both)
        self.levels.append(Level(np.concatenate([a.text, b.text]), *out))

    def _gone(self, which: np.ndarray, doc: np.ndarray, start: np.ndarray) -> None:
        if which.any():
            self.gone.append((doc[which], start[which]))


def _windows(doc: np.ndarray, start: np.ndarray) -> pd.DataFrame:
    """Windows as runs (doc_id, start, n)."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    head = np.ones(len(doc), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
    first = np.flatnonzero(head)
    last = np.append(first, len(doc))[1:] - 1
    return pd.DataFrame({"doc_id": doc[first], "start": start[first], "n": start[last] - start[first] + 1})


def _portions(frame: pd.DataFrame, array: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches as they arrived, cut into portions of about `array` bytes at most: body, sizes, ids and starts."""
    for row in frame.itertuples():
        sizes, docs, starts = (_whole(x) for x in (row.b, row.c, row.d))
        end = np.cumsum(sizes)
        body = pa.decompress(row.a, int(end[-1]), "zstd", asbytes=True)
        cut = [0, *(np.flatnonzero(np.diff(end // array)) + 1).tolist(), len(sizes)]
        for i, j in zip(cut, cut[1:]):
            yield body[end[i] - sizes[i] : end[j - 1]], sizes[i:j], docs[i:j], starts[i:j]


def _matched(array: int):
    """Reduce side of the second step: runs of windows that also start earlier, and the most levels that there were (0: the batch alone)."""

    def matched(frame: pd.DataFrame) -> pd.DataFrame:
        if frame["kind"].iloc[0] == _DIRECT:
            columns = [np.concatenate([_whole(x) for x in frame[c]]) for c in "abc"]
            return pd.DataFrame(dict(zip(("doc_id", "start", "n"), columns, strict=True))).assign(levels=0)
        family = SuffixFamily()
        held, size = [], 0
        for body, *columns in _portions(frame, array):
            held.append((body, *columns))
            size += len(body)
            if size >= array:
                family.add(b"".join(x[0] for x in held), *(np.concatenate([x[k] for x in held]) for k in (1, 2, 3)))
                held, size = [], 0
        if held:
            family.add(b"".join(x[0] for x in held), *(np.concatenate([x[k] for x in held]) for k in (1, 2, 3)))
        gone = family.gone or [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        return _windows(*(np.concatenate(c) for c in zip(*gone, strict=True))).assign(levels=family.most)

    return matched


def repeated_windows(docs: DataFrame, n_bytes: int, array: int = ARRAY, range_bytes: int = RANGE) -> DataFrame:
    """Runs (doc_id, start, n, levels) of windows that also start earlier, of a table with doc_id (whole numbers, not null,
    one text each) and text, of n_bytes in all.

    Runs of a document may overlap. Places are in bytes of UTF-8. levels: how many the family had that found them; 0 for
    what a batch of the input found by itself.
    """
    spark = docs.sparkSession
    shards = max(2 * shuffle_partitions(spark), n_bytes // ANCHOR_RANGE)
    packed = docs.mapInPandas(_anchored(shards), _PACKED)
    found = checkpointed(packed.groupBy("key").applyInPandas(_shared_runs, _FOUND))
    open_ = found.where(F.col("status") != GONE)
    sums = found.groupBy("status").agg(F.sum(F.col("n") + WINDOW - 1).alias("b"), F.count(F.lit(1)).alias("n")).collect()  # three rows at most
    sums = {r["status"]: (r["b"], r["n"]) for r in sums}
    texts = _texts_of(docs, open_, ["start", "n", "status", "anchor"], "wanted")
    if HOT in sums:
        prints = _texts_of(docs, found.where(F.col("status") == HOT), ["start", "n"], "wanted").mapInArrow(_printed(max(shards, sums[HOT][0] // range_bytes)), _PACKED)
        again = checkpointed(prints.groupBy("key").applyInPandas(_reprinted, "doc_id long, start long, n int"))
        lists = again.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("again"))
        texts = texts.join(lists.hint("shuffle_hash"), "doc_id", "left")
    ranges = sum(sums[s][0] for s in (OPEN, HOT) if s in sums) // range_bytes + 1
    windows = texts.mapInArrow(_stretched(ranges), _PACKED).groupBy("key").applyInPandas(_matched(array), _WINDOWS)
    return found.where(F.col("status") == GONE).select("doc_id", "start", "n", F.lit(0).alias("levels")).union(windows)


def _texts_of(docs: DataFrame, runs_: DataFrame, columns: list[str], name: str) -> DataFrame:
    """(doc_id, text, and a list of the runs) of documents that have any."""
    lists = runs_.groupBy("doc_id").agg(F.collect_list(F.struct(*columns)).alias(name))
    ids = runs_.select("doc_id").distinct()
    maybe = probe(build(ids.select(F.xxhash64("doc_id")), ids.count()), docs.sparkSession)
    return docs.where(maybe(F.xxhash64("doc_id"))).join(lists.hint("shuffle_hash"), "doc_id")


def cut_out(body: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes outside [start, end) of all pairs, and the maximal stretches inside."""
    spans: list[tuple[int, int]] = []
    for i in np.argsort(starts, kind="stable").tolist():
        a, b = int(starts[i]), int(min(ends[i], len(body)))
        if a >= b:
            continue
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    at, kept = 0, []
    for a, b in spans:
        kept.append(body[at:a])
        at = b
    return b"".join([*kept, body[at:]]), spans


_CLEANED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cleaned(with_bytes: bool, listed=None):
    """listed: a filter of ids; rows whose `hash` may be in it are left out."""

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            if listed is not None:
                frame = frame[~maybe_listed(listed.value, frame["hash"].to_numpy(np.int64))].assign(gone=None)
            for doc_id, text, gone in zip(frame["doc_id"], frame["text"], frame["gone"], strict=True):
                body = text.encode("utf-8", "surrogatepass")
                kept, spans = body, []
                if gone is not None and len(gone):
                    starts = np.array([x["start"] for x in gone], np.int64)
                    kept, spans = cut_out(body, starts, starts + np.array([x["n"] for x in gone], np.int64) + WINDOW - 1)
                out.append((doc_id, len(body), len(body) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if with_bytes else b""))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
        give_back()

    return clean


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans (maximal removed stretches), kept_sha256, kept.

    kept has the bytes that stay if with_bytes (they need not be valid UTF-8), else it is empty. Null text counts as
    empty. Rows that repeat an id with the same text are one document; with another text they are documents of their
    own, of which the one whose text has the smaller 64-bit hash (xxhash64, as a signed number) is the earlier. A null id
    takes no part: nothing is removed from it, and it removes nothing. Ids are whole numbers. Other columns are ignored;
    an empty table gives an empty result.

    Copies within a batch are settled where it is read, so a lost task must read the same rows again in the same order:
    pass a table of files or a checkpoint, not the output of a shuffle.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = rows.where(F.col("doc_id").isNotNull())
    about = survey(known)
    if about.repeats:
        own, names = numbered(known)
        clean = _cleaned_rows(own.select(F.col("own").alias("doc_id"), "text"), about.n_bytes, with_bytes).withColumnRenamed("doc_id", "own")
        known_out = clean.join(names, "own").select("doc_id", *clean.columns[1:])
    else:
        known_out = _cleaned_rows(known, about.n_bytes, with_bytes)
    lost = rows.where(F.col("doc_id").isNull()).select(F.lit(0).cast("long").alias("doc_id"), "text", F.lit(None).cast("array<struct<start:bigint,n:int>>").alias("gone"))
    return known_out.union(lost.mapInPandas(_cleaned(with_bytes), _CLEANED).withColumn("doc_id", F.lit(None).cast("long")))


def _cleaned_rows(known: DataFrame, n_bytes: int, with_bytes: bool) -> DataFrame:
    spark = known.sparkSession
    gone = checkpointed(repeated_windows(known, n_bytes).select("doc_id", "start", "n"))
    lists = gone.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("gone"))
    # only texts that may lose something are joined; the others are done where they are read, in one Python worker
    words = build(gone.select(F.xxhash64("doc_id")), gone.select("doc_id").distinct().count())
    joined = known.where(probe(words, spark)(F.xxhash64("doc_id"))).join(lists.hint("shuffle_hash"), "doc_id", "left")
    apart = known.select("doc_id", "text", F.xxhash64("doc_id").alias("hash"))
    apart = apart.mapInPandas(_cleaned(with_bytes, spark.sparkContext.broadcast(words)), _CLEANED)
    return joined.select("doc_id", "text", "gone").mapInPandas(_cleaned(with_bytes), _CLEANED).union(apart)
