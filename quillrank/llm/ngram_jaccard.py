"""N-gram Jaccard join: rare-first prefix filtering over 5-word shingles, verified on whole texts, and its components.

Two documents link when 100 * intersection >= 75 * union of their shingle sets. Equal sets are found by fingerprint
(their number of shingles and 128 bits) and only one document of them goes on. If two sets link, they share a shingle
among the first n - ceil(0.75 n) + 1 of each in any common order; the order is by document frequency, rarest first.

1. Each map task turns batches of documents into shingle hashes, packed as sorted arrays and cut by range of hash.
   A shingle that many documents of a batch share goes on once, with its count; which documents have it goes with
   the batch. So no shingle brings more than a bounded number of entries for each batch to one task.
2. Each range counts document frequencies and answers each batch for its shingles of frequency 2 and more.
3. Each batch puts its documents' shingles in order. Those of frequency 1 come first and match nothing, so a document
   with enough of them has no candidates at all. What is left of a prefix are the entries of the join.
4. The join on prefix shingles: the documents of a shingle gather around its leader, the one with the smallest share
   of shingles that no one else has (the original of a family of edited copies), so shingles with one leader make one
   group. Two documents that share a prefix shingle share a leader, so comparing within leaders' groups misses nothing.
   A pair with several leaders in common is compared in one group only, the smallest leader's of those where it passes
   the positional filter (it does where its first common shingle leads to, if it links).
5. A task passes pairs through length, positional and suffix filters (the last bounds the overlap by the numbers of
   shingles in parts of the hash range), compares what is left by whole sets of hashes, and each link that joins two
   trees by the words themselves. It returns a spanning forest of the links, not the links. Large groups are split into
   blocks, each with the leader in it. Members that hang together with the leader in their block are settled among each
   other; only the others are compared with all blocks. A family of copies, however large, takes work in proportion to
   its size; a group of N documents of which many share a prefix shingle but do not link takes the pairs that any prefix
   filter leaves, in blocks, over as many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.bloom import build, probe
from quillrank.llm.common import checkpointed, give_back, hot_share, joined_by_share, numbered, shuffle_partitions, small_batches, survey
from quillrank.llm.components import connected
from quillrank.llm.row_filter import without
from quillrank.llm.shingles import fingerprint, shingle_set, shingle_strings

#: Similarity in percent.
PERCENT = 75
#: Shingles and documents of a batch; documents of a batch from which on a shingle is sent once.
BATCH_SHINGLES, BATCH_DOCS, MANY = 700_000, 60_000, 64
#: Members of a block of a group, and, about, of a task that compares them.
BLOCK, TASK_MEMBERS = 1500, 600
#: Bytes of text whose shingles a range of hashes holds, about.
SHINGLE_RANGE = 16_000_000

_SHARD, _META, _MANY = 0, 1, 2
_PACKED = "key long, kind int, batch long, a binary, b binary, c binary, d binary"


def prefix_length(n, percent: int = PERCENT):
    """Shingles of a set of n that any set it links with shares at least one of, under one order."""
    return n - (percent * n + 99) // 100 + 1


def _squashed(sorted_hashes: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte plane by byte plane: the high planes are nearly all zero and compress."""
    return np.ascontiguousarray(np.diff(sorted_hashes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def _restored(planes: bytes) -> np.ndarray:
    flat = np.frombuffer(planes, np.uint8)
    return np.cumsum(np.ascontiguousarray(flat.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _packed(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["key", "kind", "batch", "a", "b", "c", "d"])


def _emitted(shards: int, many_docs: int):
    def flush(batch: int, ids: list[int], sets: list[np.ndarray]) -> pd.DataFrame:
        prints = np.array([fingerprint(s) for s in sets], np.int64).reshape(-1, 2)
        sizes = np.array([len(s) for s in sets], np.int64)
        own = np.array(ids, np.int64)
        first: dict[tuple, int] = {}
        for i in np.argsort(own, kind="stable").tolist():
            first.setdefault((*prints[i].tolist(), int(sizes[i])), i)
        chosen = [i for i in sorted(first.values()) if sizes[i]]
        leads = np.zeros(len(own), bool)
        leads[chosen] = True
        rows = [(-1 - batch, _META, batch, own.tobytes(), sizes.tobytes(), prints.tobytes(), leads.tobytes())]
        if chosen:
            hashes = np.concatenate([sets[i] for i in chosen])
            docs = np.repeat(np.array(chosen, np.uint16), sizes[chosen])
            order = np.argsort(hashes, kind="stable")
            hashes, docs = hashes[order], docs[order]
            starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            times = np.diff(starts, append=len(hashes))
            unique, many = hashes[starts], times >= many_docs
            each = np.repeat(many, times)
            if many.any():
                rows.append((-1 - batch, _MANY, batch, _squashed(unique[many]), times[many].astype(np.uint16).tobytes(), docs[each].tobytes(), b""))
            cuts = (np.arange(1, shards, dtype=object) * (1 << 64) // shards).astype(np.uint64)
            at = np.concatenate([[0], np.searchsorted(unique, cuts), [len(unique)]])
            few_before = np.concatenate([[0], np.cumsum(np.where(many, 0, times))])
            few = docs[~each]
            for s in range(shards):
                x, y = at[s], at[s + 1]
                if y > x:
                    rows.append((s, _SHARD, batch, _squashed(unique[x:y]), times[x:y].astype(np.uint16).tobytes(), few[few_before[x] : few_before[y]].tobytes(), b""))
        return _packed(rows)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, ids, sets, total = TaskContext.get().partitionId() << 24, [], [], 0
        for frame in batches:
            for doc_id, text in zip(frame["doc_id"].tolist(), frame["text"], strict=True):
                found = shingle_set(text)
                ids.append(doc_id)
                sets.append(found)
                total += len(found)
                if total >= BATCH_SHINGLES or len(ids) >= BATCH_DOCS:
                    yield flush(number, ids, sets)
                    give_back()
                    number, ids, sets, total = number + 1, [], [], 0
        if ids:
            yield flush(number, ids, sets)
        give_back()

    return emit


def _counted(frame: pd.DataFrame, many_docs: int) -> pd.DataFrame:
    """Answers each batch: of its shingles in this range, those that two or more documents have, with their frequency."""
    if frame["kind"].iloc[0] != _SHARD:
        return frame.assign(key=frame["batch"])
    hashes = [_restored(x) for x in frame["a"]]
    times = [np.frombuffer(x, np.uint16) for x in frame["b"]]
    unique, back = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(back, np.concatenate(times), len(unique)).astype(np.int64)
    give_back()
    rows, at = [], 0
    for batch, own, count, docs in zip(frame["batch"].tolist(), hashes, times, frame["c"], strict=True):
        frequency = total[back[at : at + len(own)]]
        at += len(own)
        shared = frequency > 1
        few = np.where(count < many_docs, count, 0)
        kept = np.frombuffer(docs, np.uint16)[np.repeat(shared, few)]
        rows.append((batch, _SHARD, batch, _squashed(own[shared]), count[shared].tobytes(), kept.tobytes(), frequency[shared].tobytes()))
    return _packed(rows)


_ORDERED = "kind int, doc_id long, n long, x long, y long, u long"


def _ordered(frame: pd.DataFrame, many_docs: int) -> pd.DataFrame:
    """Of a batch: a row for each document (kind 0: x and y its fingerprint), and its prefix entries (kind 1: x the shingle, y its position)."""
    meta = frame[frame["kind"] == _META].iloc[0]
    ids, sizes = np.frombuffer(meta["a"], np.int64), np.frombuffer(meta["b"], np.int64)
    prints, leads = np.frombuffer(meta["c"], np.int64).reshape(-1, 2), np.frombuffer(meta["d"], bool)
    out = [pd.DataFrame({"kind": 0, "doc_id": ids, "n": sizes, "x": prints[:, 0], "y": prints[:, 1], "u": 0})]
    held: dict[int, np.ndarray] = {}
    for row in frame[frame["kind"] == _MANY].itertuples():
        times = np.frombuffer(row.b, np.uint16)
        held = dict(zip(_restored(row.a).tolist(), np.split(np.frombuffer(row.c, np.uint16), np.cumsum(times)[:-1]), strict=True))
    docs, hashes, frequency = [], [], []
    for row in frame[frame["kind"] == _SHARD].itertuples():
        own, times, f = _restored(row.a), np.frombuffer(row.b, np.uint16), np.frombuffer(row.d, np.int64)
        few = times < many_docs
        docs.append(np.frombuffer(row.c, np.uint16))
        hashes.append(np.repeat(own[few], times[few]))
        frequency.append(np.repeat(f[few], times[few]))
        for h, g in zip(own[~few].tolist(), f[~few].tolist(), strict=True):
            docs.append(held[h])
            hashes.append(np.full(len(held[h]), h, np.uint64))
            frequency.append(np.full(len(held[h]), g, np.int64))
    if docs:
        docs, hashes, frequency = (np.concatenate(v) for v in (docs, hashes, frequency))
        order = np.lexsort((hashes, frequency, docs))
        docs, hashes = docs[order].astype(np.int64), hashes[order]
        shared = np.bincount(docs, minlength=len(ids))
        place = np.arange(len(docs)) - (np.cumsum(shared) - shared)[docs] + (sizes - shared)[docs]
        kept = (place < prefix_length(sizes)[docs]) & leads[docs]
        d = docs[kept]
        out.append(pd.DataFrame({"kind": 1, "doc_id": ids[d], "n": sizes[d], "x": hashes[kept].view(np.int64), "y": place[kept], "u": (sizes - shared)[d]}))
    return pd.concat(out, ignore_index=True)


#: Parts that the suffix filter counts shingles in.
_PARTS = 16


_FOREST = "kind int, leader long, u long, v long"


def _linked(frame: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links among a task's documents: kind 0, (u, v), v the smallest document of a tree.

    Rows with side 0 and 1: only pairs across are compared. With side -1 all are, and in a group of several blocks the
    documents outside the leader's tree are returned too: kind 1, u.

    Sorted by size, so that the length filter leaves a range. The positional filter bounds the overlap by what follows
    the first entry that brought a document to this group, the suffix filter by the counts of shingles in parts of the
    hash range. Documents of one tree aren't compared again, nor those that pass the positional filter in a smaller leader's
    group too (but for the leader itself, so that its family hangs together here).
    """
    frame = frame.drop_duplicates(["doc_id", "text", "side"], ignore_index=True)
    leader, several = int(frame["leader"].iloc[0]), bool(frame["blocks"].iloc[0] > 1)
    sets = [shingle_set(t) for t in frame["text"]]
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), int(frame["doc_id"].iloc[i])))
    frame, sets = frame.iloc[order], [sets[i] for i in order]
    ids, side, place = (frame[c].to_numpy(np.int64) for c in ("doc_id", "side", "place"))
    sizes = np.array([len(s) for s in sets], np.int64)
    unique, back = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(back, minlength=len(unique))[back] > 1
    back, owner = back[shared], owner[shared]
    ends = np.searchsorted(owner, np.arange(len(sets) + 1))
    part = (unique >> np.uint64(60)).astype(np.int64)[back]
    counts = np.bincount(owner * _PARTS + part, minlength=len(sets) * _PARTS).reshape(-1, _PARTS)
    follow = sizes - place
    across = side[0] >= 0
    tree = np.arange(len(sets))
    marked = np.zeros(len(unique), bool)
    groups = [np.asarray(x, np.int64) for x in frame["leaders"]]
    own = np.concatenate(groups) < leader
    lead_of = np.repeat(np.arange(len(sets)), [len(x) for x in groups])[own]
    others, lead = np.unique(np.concatenate(groups)[own], return_inverse=True)
    lead_follow = sizes[lead_of] - np.concatenate([np.asarray(x, np.int64) for x in frame["places"]])[own]
    lead_ends, mine_follow = np.searchsorted(lead_of, np.arange(len(sets) + 1)), np.zeros(len(others), np.int64)
    texts = frame["text"].tolist()
    for i in range(len(sets) - 1):
        longest = int(np.searchsorted(sizes, 100 * sizes[i] // PERCENT, "right"))
        other = np.arange(i + 1, max(i + 1, longest))
        least = PERCENT * (sizes[other] + sizes[i])  # 175 * overlap reaches this if they link
        able = (tree[other] != tree[i]) & ((100 + PERCENT) * np.minimum(follow[other], follow[i]) >= least)
        if across:
            able &= side[other] != side[i]
        if ids[i] != leader and lead_ends[i] < lead_ends[i + 1]:
            mine = slice(lead_ends[i], lead_ends[i + 1])
            mine_follow[lead[mine]] = lead_follow[mine]
            passes = (100 + PERCENT) * np.minimum(lead_follow, mine_follow[lead]) >= PERCENT * (sizes[lead_of] + sizes[i])
            mine_follow[lead[mine]] = 0
            elsewhere = np.bincount(lead_of[passes], minlength=len(sets)) > 0
            able &= ~elsewhere[other] | (ids[other] == leader)
        other, least = other[able], least[able]
        other = other[(100 + PERCENT) * np.minimum(counts[other], counts[i]).sum(axis=1) >= least]
        if not len(other):
            continue
        marked[back[ends[i] : ends[i + 1]]] = True
        if len(other) < 32:
            both = np.array([np.count_nonzero(marked[back[ends[j] : ends[j + 1]]]) for j in other.tolist()])
        else:
            rest = slice(ends[other[0]], ends[other[-1] + 1])
            both = np.bincount(owner[rest][marked[back[rest]]], minlength=len(sets))[other]
        marked[back[ends[i] : ends[i + 1]]] = False
        mine = None
        for j in other[100 * both >= PERCENT * (sizes[other] + sizes[i] - both)].tolist():
            if tree[j] != tree[i]:
                mine = mine if mine is not None else shingle_strings(texts[i])
                if _link(mine, shingle_strings(texts[j])):
                    a, b = sorted((tree[i], tree[j]))
                    tree[tree == b] = a
    apart = tree != np.arange(len(sets))
    out = pd.DataFrame({"kind": 0, "leader": leader, "u": ids[apart], "v": ids[tree[apart]]})
    if several and not across:
        loose = ~np.isin(tree, tree[ids == leader])
        out = pd.concat([out, pd.DataFrame({"kind": 1, "leader": leader, "u": ids[loose], "v": ids[loose]})], ignore_index=True)
    give_back()
    return out


def _link(a: set[bytes], b: set[bytes]) -> bool:
    both = len(a & b)
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _packed_documents(docs: DataFrame, shards: int, many_docs: int) -> DataFrame:
    packed = docs.mapInPandas(_emitted(shards, many_docs), _PACKED)
    counted = packed.groupBy("key").applyInPandas(lambda frame: _counted(frame, many_docs), _PACKED)
    return counted.groupBy("batch").applyInPandas(lambda frame: _ordered(frame, many_docs), _ORDERED)


def _copies(own: DataFrame, ranges: int) -> DataFrame:
    """(u, v): documents whose set another one with a smaller id has, and the smallest such id."""
    key = ["n", "x", "y"]
    own = own.where("n > 0")
    classes = own.groupBy(*key).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    classes = checkpointed(classes.where("copies > 1"))
    found = joined_by_share(own, classes, key, "copies", hot_share(own.count(), ranges))
    return found.where(F.col("doc_id") != F.col("first_id")).select(F.col("doc_id").alias("u"), F.col("first_id").alias("v"))


def _members(entries: DataFrame, ranges: int) -> DataFrame:
    """(leader, doc_id, place) of groups of two and more; place is the first position of an entry that led there."""
    rank = F.struct((F.col("u") / F.col("n")).alias("own"), "doc_id")
    leaders = entries.groupBy("x").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > 1)
    leaders = checkpointed(leaders.select("x", F.col("first.doc_id").alias("leader"), "n_docs"))
    entries = entries.select("x", "doc_id", "y")
    share = hot_share(leaders.agg(F.sum("n_docs")).first()[0] or 0, ranges)
    return checkpointed(joined_by_share(entries, leaders, ["x"], "n_docs", share).groupBy("leader", "doc_id").agg(F.min("y").alias("place")))


def _links(docs: DataFrame, members: DataFrame, block: int, ranges: int) -> DataFrame:
    """Verified links (u, v), as spanning forests."""
    spark = docs.sparkSession
    by_doc = members.groupBy("doc_id").agg(F.collect_list(F.struct("leader", "place")).alias("all"))  # a prefix bounds them
    by_doc = checkpointed(by_doc.select("doc_id", F.col("all.leader").alias("leaders"), F.col("all.place").alias("places")))
    maybe = probe(build(by_doc.select(F.xxhash64("doc_id")), by_doc.count()), spark)
    texts = docs.where(maybe(F.xxhash64("doc_id"))).join(by_doc, "doc_id")
    groups = checkpointed(members.groupBy("leader").agg(F.count(F.lit(1)).alias("size")))
    n_members = groups.agg(F.sum("size")).first()[0] or 0
    share, tasks = hot_share(n_members, ranges), min(max(ranges, n_members // TASK_MEMBERS), 50 * ranges)
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    blocks = groups.withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    placed = joined_by_share(members, blocks, ["leader"], "size", share).drop("size").withColumn("own", own)
    every = F.sequence(F.lit(0), F.col("blocks") - 1)

    def compared(chosen: DataFrame) -> DataFrame:
        rows = texts.join(chosen, "doc_id").repartition(tasks, "leader", "i", "j")  # by number: bytes don't tell the work
        return checkpointed(rows.groupBy("leader", "i", "j").applyInPandas(_linked, _FOREST))

    first = placed.withColumn("j", F.explode(F.when(F.col("doc_id") == F.col("leader"), every).otherwise(F.array("own"))))
    found = compared(first.select("leader", "doc_id", "place", "blocks", F.lit(-1).alias("side"), F.lit(0).alias("i"), "j"))
    links = found.where("kind = 0").select("u", "v")
    loose = checkpointed(found.where("kind = 1").select("leader", F.col("u").alias("doc_id")).distinct())
    if loose.isEmpty():
        return links
    parts = loose.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")).join(groups, "leader")
    both = joined_by_share(placed, checkpointed(parts), ["leader"], "size", share).drop("size")
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    one = both.join(loose, ["leader", "doc_id"], "left_semi").select("leader", "doc_id", "place", "blocks", F.lit(0).alias("side"), part.alias("i"), F.explode(every).alias("j"))
    other = both.select("leader", "doc_id", "place", "blocks", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.col("own").alias("j"))
    return links.union(compared(one.unionByName(other)).select("u", "v"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", many_docs: int = MANY, block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included).

    Null text counts as empty; texts without words have no shingles and link with nothing. Rows that repeat an id are
    one node, linked if any of their texts links; each has its own n_shingles. A null id takes no part: its component
    is null. Ids are whole numbers. Other columns are ignored; an empty table gives an empty result.

    Batches of documents are numbered where they are read, so a lost task must read the same rows again in the same
    order: pass a table of files or a checkpoint, not the output of a shuffle.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = rows.where(F.col("doc_id").isNotNull())
    about = survey(known)
    if about.repeats:
        own, names = numbered(known)
        first = names.groupBy("doc_id").agg(F.min("own").alias("v"))
        same = names.join(first, "doc_id").where(F.col("own") != F.col("v")).select(F.col("own").alias("u"), "v")
        found = _components(own.select(F.col("own").alias("doc_id"), "text"), about.n_bytes, many_docs, block, same)
        found = found.withColumnRenamed("doc_id", "own").join(names, "own")
        roots = names.select(F.col("own").alias("component_id"), F.col("doc_id").alias("root_id"))
        parts = found.join(roots, "component_id").select("doc_id", "n_shingles", F.col("root_id").alias("component_id"))
    else:
        parts = _components(known, about.n_bytes, many_docs, block)
    lost = rows.where(F.col("doc_id").isNull()).mapInPandas(_sizes, "n_shingles long")
    return parts.union(lost.select(F.lit(None).cast("long"), "n_shingles", F.lit(None).cast("long")))


def _components(known: DataFrame, n_bytes: int, many_docs: int, block: int, more: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of rows whose id has one text; more: links from elsewhere."""
    ranges = shuffle_partitions(known.sparkSession)
    shards = max(2 * ranges, n_bytes // SHINGLE_RANGE)
    ordered = checkpointed(_packed_documents(known, shards, many_docs))
    own = ordered.where("kind = 0").select("doc_id", "n", "x", "y")
    copies = checkpointed(_copies(own, ranges))
    entries = ordered.where("kind = 1").join(copies.select(F.col("u").alias("doc_id")), "doc_id", "left_anti")
    links = _links(known, _members(entries, ranges), block, ranges).union(copies)
    found = connected(links.union(more) if more is not None else links)
    parts = own.select("doc_id", F.col("n").alias("n_shingles")).join(found, F.col("doc_id") == F.col("node"), "left")
    return parts.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"n_shingles": [len(shingle_set(t)) for t in batch["text"]]})


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows that stay, with all their columns: of each component the document with the smallest id.

    Texts without words, null ones too, are components of their own and stay, as do null ids and all rows that repeat
    the id that stays. Column names may be any; an empty table gives an empty result.
    """
    found = jaccard_components(docs, id_col, text_col)
    return without(docs, id_col, found.where(F.col("doc_id") != F.col("component_id")).select("doc_id"))
