"""Jaccard self-join of documents on word n-grams, by prefix trees over globally ordered sets.

1. Every text becomes its set of hashed n-grams; equal sets are one class from here on.
2. The global order puts rare n-grams first: by document frequency (in powers of two), then by hash;
   n-grams in more than ``HEAVY`` of all documents come last.  Frequencies are counted in buckets of
   n-grams: tasks send 32-bit fingerprints packed by bucket, and buckets tell the tasks' packets which of theirs
   are found twice or more.
3. By the prefix principle two sets of similarity ``t`` share one of the first
   ``n - ceil(t n) + 1`` n-grams of both.  N-grams found once can't be shared, so nearly all documents
   drop out here.  Packets link their own classes that share a prefix n-gram and have sizes within
   ``t``, and send on one representative of each linked run (the run's range of sizes) an n-gram;
   buckets link the representatives the same way.  Linking is by union-find along sorted sizes, so a group
   of ``m`` costs ``m`` edges, never ``m ** 2`` pairs.
4. The connected groups hold every similar pair.  In a group the sets are put one by one into a prefix tree
   (common n-grams first, so near copies share their paths).  A new set walks the tree with the
   overlap so far and the sizes still possible below; subtrees that cannot reach the threshold, or that
   are already in the new set's component, are pruned.  Every link between components is found.
   Groups of more than ``GROUP_TOKENS`` n-grams are cut into bands of sizes and those into parts, and pairs of parts
   of the same band or of neighbours, which are all that can be similar, are walked in separate tasks.
5. Components are closed by distributed label propagation with pointer jumping.

The order never changes the result: any global order is exact, and fingerprints that collide only add
candidates.  The list of heavy n-grams has at most ``2 * mean set size / HEAVY`` entries whatever the
input, so it is sent to all.  The result is exact but for collisions of 64-bit hashes in a pair.

Defined results: null and blank texts have an empty set and are linked with nothing; a text of fewer
than ``n`` words is one n-gram; repeated rows are linked as equal sets; rows without an id take part like others, and a component without
any id has none; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common
from ._common import by_bytes, find_words, hash_words, kept, mix, spread_join, text_arrays

#: Share of the documents beyond which an n-gram is heavy; a task reports those beyond half of it.
HEAVY = 1 / 256
GROUP_TOKENS = 8_000_000
BUCKET_ROWS = 1 << 18
#: A packet's n-grams and documents (numbered in 16 bits; a slice of at most 16,384 may come on top).
PACKET_GRAMS, PACKET_DOCS = 2_500_000, 45_000
#: Fingerprints that a task sends at once.
PORTION = 1 << 18
SMALL_EDGES = 500_000
SLICE = 1 << 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of all texts, one after the other, and their ``len + 1`` edges."""
    starts, ends, rows = find_words(data, offsets)
    words = hash_words(data, starts, ends)
    count = np.bincount(rows, minlength=len(offsets) - 1)
    odd = np.random.default_rng(n).integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)
    at = np.flatnonzero(rows[: max(len(rows) - n + 1, 0)] == rows[n - 1 :]) if len(rows) >= n else np.zeros(0, np.int64)
    grams, owner = np.zeros(len(at), np.uint64), rows[at]
    for k in range(n):
        grams += words[at + k] * odd[k]
    if (few := np.flatnonzero((count > 0) & (count < n))).size:
        first = np.searchsorted(rows, few)
        short = count[few].astype(np.uint64)
        for k in range(n - 1):
            use = count[few] > k
            short[use] += words[first[use] + k] * odd[k]
        grams, owner = np.concatenate([grams, short]), np.concatenate([owner, few])
        order = np.argsort(owner, kind="stable")
        grams, owner = grams[order], owner[order]
    grams = mix(grams)
    edge = np.searchsorted(owner, np.arange(len(offsets))).tolist()
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        grams[a:b].sort()
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    return grams, np.searchsorted(owner, np.arange(len(offsets)))


def signatures(grams: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """One signed 64-bit number a set: order-free, so equal sets and only they agree."""
    total = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(mix(grams ^ np.uint64(0xC2B2AE3D27D4EB4F)), out=total[1:])
    size = np.diff(edges).astype(np.uint64)
    return mix(total[edges[1:]] - total[edges[:-1]] + size * np.uint64(0x9FB21C651E98DF25)).view(np.int64)


class Union:
    """Union-find over ``0 .. n-1``."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def link_runs(gram: np.ndarray, low: np.ndarray, high: np.ndarray, node: np.ndarray, n: int, t: float) -> tuple[Union, np.ndarray, np.ndarray]:
    """Links nodes that share an n-gram and whose size ranges come within ``t`` of each other.

    Returns the union, the order of the postings, and where a run of linked postings begins in it.
    """
    order = np.lexsort((low, gram))
    gram, low, high, node = gram[order], low[order], high[order], node[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = gram[1:] != gram[:-1]
    reach = high.copy()
    if len(reach):  # the largest size so far in the n-gram: ranges are put apart by the n-gram's number
        shift = np.cumsum(fresh) * (int(high.max()) + 1)
        reach = np.maximum.accumulate(reach + shift) - shift
        fresh[1:] |= low[1:] * t > reach[:-1] + 1e-9
    union = Union(n)
    follow = np.flatnonzero(~fresh)
    pairs = np.unique(np.stack([node[follow - 1], node[follow]], 1), axis=0) if len(follow) else np.zeros((0, 2), np.int64)
    for i, j in pairs.tolist():
        union.join(i, j)
    return union, order, np.flatnonzero(fresh)


class PrefixTree:
    """Sets of small integers in ascending order; each node holds a run of them shared by all below."""

    def __init__(self) -> None:
        self.runs: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.kids: list[dict[int, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.sizes: list[list[int]] = [[1 << 60, 0]]  # smallest and largest set below
        self.group: list[int] = [-2]  # a set below if all below are in one component; -1 if not

    def _node(self, run: np.ndarray, end: int, size: int) -> int:
        self.runs.append(run)
        self.kids.append({})
        self.ends.append([end])
        self.sizes.append([size, size])
        self.group.append(end)
        return len(self.runs) - 1

    def add(self, items: np.ndarray, name: int, union: Union) -> None:
        node, at = 0, 0
        while True:
            size = self.sizes[node]
            size[0], size[1] = min(size[0], len(items)), max(size[1], len(items))
            if self.group[node] == -2:
                self.group[node] = name
            elif self.group[node] >= 0 and union.find(self.group[node]) != union.find(name):
                self.group[node] = -1
            if at == len(items):
                self.ends[node].append(name)
                return
            kid = self.kids[node].get(int(items[at]))
            if kid is None:
                self.kids[node][int(items[at])] = self._node(items[at:], name, len(items))
                return
            run = self.runs[kid]
            most = min(len(run), len(items) - at)
            apart = np.flatnonzero(run[:most] != items[at : at + most])
            same = int(apart[0]) if len(apart) else most
            if same < len(run):  # split the run
                lower = self._node(run[same:], -1, 0)
                self.kids[lower], self.ends[lower] = self.kids[kid], self.ends[kid]
                self.sizes[lower], self.group[lower] = list(self.sizes[kid]), self.group[kid]
                self.runs[kid], self.kids[kid], self.ends[kid] = run[:same], {int(run[same]): lower}, []
            node, at = kid, at + same

    def link(self, items: np.ndarray, mark: np.ndarray, name: int, union: Union, t: float) -> None:
        """Joins ``name`` with every component that has a set similar to ``items`` (marked in ``mark``).

        With overlap ``o`` at depth ``d``, sets below have ``s`` items and share at most
        ``o + min(s - d, items left after the node's last)``.
        """
        n = len(items)
        low, high = math.ceil(t * n - 1e-9), n / t + 1e-9
        stack = [(0, 0, 0)]
        while stack:
            node, depth, overlap = stack.pop()
            group = self.group[node]
            if group >= 0 and union.find(group) == union.find(name):
                continue
            small, large = self.sizes[node]
            if small > high or large < low:
                continue
            run = self.runs[node]
            depth += len(run)
            if len(run):
                overlap += int(np.count_nonzero(mark[run]))
                left = n - int(np.searchsorted(items, run[-1], "right"))
                # the size that gains most is the one with as many items below as are left here
                size = min(max(depth + left, small, low), large, int(high))
                best = overlap + min(left, size - depth)
                if best * (1 + t) < t * (n + size) - 1e-9:
                    continue
            for end in self.ends[node]:
                if overlap >= t * (n + depth - overlap) - 1e-9:
                    union.join(end, name)
                    break
            stack += [(kid, depth, overlap) for kid in self.kids[node].values()]


def link_group(sets: list[np.ndarray], t: float) -> list[int]:
    """The component (smallest index) of each set under similarity ``t`` or more."""
    union = Union(len(sets))
    vocabulary, back, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(len(vocabulary), np.int64)
    place[np.lexsort((vocabulary, -times))] = np.arange(len(vocabulary))
    edges = np.r_[0, np.cumsum([len(s) for s in sets])]
    ranked = place[back]
    mark, tree = np.zeros(len(vocabulary), bool), PrefixTree()
    for i in sorted(range(len(sets)), key=lambda i: (len(sets[i]), i)):
        items = np.sort(ranked[edges[i] : edges[i + 1]])
        mark[items] = True
        tree.link(items, mark, i, union, t)
        mark[items] = False
        tree.add(items, i, union)
    return [union.find(i) for i in range(len(sets))]


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for edges ``a, b``: the smallest node that links reach.

    Up to ``SMALL_EDGES`` (counted first) are closed by one task; more go in rounds, each checkpointed.
    """
    if edges.count() <= SMALL_EDGES:

        def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = list(batches)
            if not found:
                return
            ends = [np.concatenate([x.column(k).to_numpy() for x in found]) for k in (0, 1)]
            names, number = np.unique(np.concatenate(ends), return_inverse=True)
            union = Union(len(names))
            for i, j in number.reshape(2, -1).T.tolist():
                union.join(i, j)
            label = names[[union.find(i) for i in range(len(names))]] if len(names) else names
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(label)], ["node", "label"])

        return edges.select("a", "b").repartition(1).mapInArrow(close, "node long, label long")
    return components_in_rounds(edges)


def components_in_rounds(edges: DataFrame) -> DataFrame:
    """The same by least labels of neighbours and pointer jumping."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    # large-star and small-star in one: every node points at the least of its neighbours' labels
    labels = kept(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"))
    both = kept(both)
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = labels.join(seen.withColumnRenamed("a", "node"), "node").join(jump, "label", "left")
        step = kept(step.select("node", F.least("label", "near", "far").alias("label"), F.col("label").alias("old")))
        if step.where("label <> old").isEmpty():
            return step.select("node", "label")
        labels = step.select("node", "label")


def similar_classes(docs: DataFrame, t: float = 0.75, n: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``."""
    docs = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, settled = 0, 0
        often, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        pending: list[np.ndarray] = []

        def settle() -> None:
            nonlocal settled, often, count
            values = _taken(pending)
            values.sort()
            edge = np.flatnonzero(np.r_[True, values[1:] != values[:-1], True]) if len(values) else np.zeros(1, np.int64)
            some = np.flatnonzero(np.diff(edge) >= max(2, (rows - settled) * HEAVY / 8))
            values, times = values[edge[some]], edge[some + 1] - edge[some]
            settled = rows
            names, back = np.unique(np.concatenate([often, values]), return_inverse=True)
            count = np.bincount(back, np.concatenate([count, times]), len(names)).astype(np.int64)
            often, count = names[count >= rows * HEAVY / 8], count[count >= rows * HEAVY / 8]  # others would have to come far oftener from here on

        for part in by_bytes(batches, "text", SLICE):
            grams, edges = shingle_sets(*text_arrays(part.column(1)), n)
            signs = signatures(grams, edges)
            _, one = np.unique(signs, return_index=True)
            keep = np.zeros(len(signs), bool)
            keep[one] = True
            pending.append(grams[np.repeat(keep, np.diff(edges))])
            rows += len(signs)
            if sum(map(len, pending)) > 2_000_000:
                settle()
            none = pa.nulls(len(signs), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(signs), pa.array(np.diff(edges)), none, none], ["doc_id", "sign", "n", "gram", "times"])
        if pending:
            settle()
        heavy = count >= max(8, rows * HEAVY / 2)
        if heavy.any():
            none = pa.nulls(int(heavy.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.array(often[heavy].view(np.int64)), pa.array(count[heavy])], ["doc_id", "sign", "n", "gram", "times"])

    described = kept(docs.mapInArrow(describe, "doc_id long, sign long, n long, gram long, times long"))
    heavy = described.where("gram is not null").groupBy("gram").agg(F.sum("times").alias("times"))
    members = described.where("gram is null").select("doc_id", "sign", "n")
    classes = kept(members.where("n > 0").groupBy("sign", "n").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")))
    size = classes.agg(F.count("*").alias("sets"), F.coalesce(F.sum("n"), F.lit(0)).alias("grams")).first()
    floor = max(8, size["sets"] * HEAVY / 2)
    last = np.sort(heavy.where(F.col("times") >= floor).select("gram").toArrow().column("gram").to_numpy().view(np.uint64))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(last)
    buckets = max(1, math.ceil(size["grams"] / BUCKET_ROWS))
    prefix = lambda n_: n_ - np.ceil(t * n_ - 1e-9).astype(np.int64) + 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, int] = {}
        sizes: list[int] = []
        late, packet = shared.value, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24
        light, hot_ = ([], [], []), ([], [])  # fingerprints, buckets and owners; heavy n-grams and owners

        def flush() -> Iterator[pa.RecordBatch]:
            if not known:
                return
            n_, (hot, whose) = np.array(sizes, np.int64), map(_taken, hot_)
            h = np.bincount(whose, minlength=len(n_))
            reach = prefix(n_) - (n_ - h)  # heavy n-grams that the prefix reaches
            place = np.arange(len(hot)) - np.searchsorted(whose, np.arange(len(n_)))[whose]
            hot, whose = hot[place < reach[whose]], whose[place < reach[whose]]
            own = (np.array(list(known), np.int64), n_.astype(np.int32), h.astype(np.int32), whose, hot)
            yield _packets([-1 - packet], packet, [[x.tobytes()] for x in own])
            yield from _by_bucket(*light, packet)

        for part in by_bytes(batches, "text", SLICE):
            grams, edges = shingle_sets(*text_arrays(part.column(1)), n)
            signs, n_ = signatures(grams, edges), np.diff(edges)
            number = np.full(len(signs), -1, np.int32)
            for i, (sign, k) in enumerate(zip(signs.tolist(), n_.tolist(), strict=True)):
                if k and sign not in known:
                    number[i] = known[sign] = len(sizes)
                    sizes.append(k)
            whose = np.repeat(number, n_)
            grams, whose = grams[whose >= 0], whose[whose >= 0].astype(np.uint16)
            heavy = np.zeros(len(grams), bool)
            if len(late):
                heavy = late[np.minimum(np.searchsorted(late, grams), len(late) - 1)] == grams
            rare = grams[~heavy]
            for kept_, x in zip((*light, *hot_), ((rare >> np.uint64(32)).astype(np.uint32), (rare % np.uint64(buckets)).astype(np.int32), whose[~heavy], grams[heavy], whose[heavy]), strict=True):
                kept_.append(x)
            if sum(map(len, light[0])) + sum(map(len, hot_[0])) > PACKET_GRAMS or len(sizes) > PACKET_DOCS:
                yield from flush()
                known.clear(), sizes.clear()
                packet += 1
        yield from flush()

    def tell(key: tuple, table: pa.Table) -> pa.Table:
        """Of a bucket's fingerprints those found in two packets or sets, with their frequency class."""
        if key[0].as_py() < 0:
            return table
        marks = [np.frombuffer(x, np.uint32) for x in table.column("a").to_pylist()]
        _, back, times = np.unique(np.concatenate(marks), return_inverse=True, return_counts=True)
        kind = np.minimum(np.log2(times), 250).astype(np.uint8)[back]
        rows, at = [], 0
        for mark, whom in zip(marks, table.column("b").to_pylist(), strict=True):
            own = kind[at : at + len(mark)]
            at += len(mark)
            some = own > 0
            to = np.cumsum(np.frombuffer(whom, np.uint16).astype(np.int64)).astype(np.uint16)
            rows.append((mark[some].tobytes(), to[some].tobytes(), own[some].tobytes()))
        a, b, c = (pa.array(x, pa.binary()) for x in zip(*rows, strict=True))
        none = pa.nulls(len(rows), pa.binary())
        return pa.table([table.column("key"), table.column("packet"), a, b, c, none, none], names=_PACKET)

    def meet_own(table: pa.Table) -> pa.Table:
        """Prefixes of a packet's sets in the global order, linked among themselves."""
        keys = table.column("key").to_numpy()
        head = table.slice(int(np.flatnonzero(keys < 0)[0]), 1).to_pylist()[0]
        signs, n_, h = np.frombuffer(head["a"], np.int64), np.frombuffer(head["b"], np.int32).astype(np.int64), np.frombuffer(head["c"], np.int32)
        rest = table.filter(pa.array(keys >= 0))
        join = lambda c, kind: np.frombuffer(b"".join(rest.column(c).to_pylist()), kind)
        lengths = [len(x) for x in rest.column("c").to_pylist()]
        gram = np.repeat(rest.column("key").to_numpy().astype(np.uint64) << np.uint64(32), lengths)
        gram |= join("a", np.uint32)
        owner = join("b", np.uint16).astype(np.uint32) << np.uint32(8) | join("c", np.uint8)  # with the frequency class below
        order = np.lexsort((gram, owner))
        gram, owner = gram[order], (owner[order] >> np.uint32(8)).astype(np.int32)
        del order
        once = n_ - h - np.bincount(owner, minlength=len(n_))
        first = np.arange(len(gram)) < (np.searchsorted(owner, np.arange(len(n_))) + prefix(n_) - once)[owner]
        hot, whose = np.frombuffer(head["e"], np.uint64), np.frombuffer(head["d"], np.uint16).astype(np.int64)
        gram, node = np.concatenate([gram[first], hot]), np.concatenate([owner[first], whose])
        if not len(gram):
            return _table([])
        union, order, begin = link_runs(gram, n_[node], n_[node], node, len(n_), t)
        root = np.array([union.find(i) for i in range(len(n_))])
        moved = np.flatnonzero(root != np.arange(len(n_)))
        gram, node = gram[order], node[order]
        low, high = n_[node][begin].astype(np.int32), np.maximum.reduceat(n_[node], begin).astype(np.int32)
        places = max(1, buckets // 4)
        bucket = (mix(gram[begin]) % np.uint64(places)).astype(np.int64)
        return _table([*_edges(signs[moved], signs[root[moved]]), *_postings(bucket, gram[begin], signs[root[node[begin]]], low, high)])

    told = docs.mapInArrow(send, _PACKET_SCHEMA).groupBy("key").applyInArrow(tell, _PACKET_SCHEMA)
    first = told.groupBy("packet").applyInArrow(meet_own, _FIRST)

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return table.select(["a", "b"])
        name = [np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("grams", "nodes")]
        name += [np.frombuffer(b"".join(table.column(c).to_pylist()), np.int32).astype(np.int64) for c in ("lows", "highs")]
        names, node = np.unique(name[1], return_inverse=True)
        union, _, _ = link_runs(name[0].view(np.uint64), name[2], name[3], node, len(names), t)
        root = np.array([union.find(i) for i in range(len(names))])
        moved = np.flatnonzero(root != np.arange(len(names)))
        return pa.table({"a": names[moved], "b": names[root[moved]]})

    # edges found in a task are spread over keys below 0
    edges = kept(first.groupBy("bucket").applyInArrow(meet, "a long, b long").distinct())
    if edges.isEmpty():
        return _joined(members, classes, classes.select("sign", F.col("doc_id").alias("component_id")).where("false"))
    groups = components(edges)
    suspects = kept(classes.join(groups, classes["sign"] == groups["node"]).select("doc_id", "sign", "n", F.col("label").alias("group")))
    # a group of many n-grams is cut into bands of sizes, of which only neighbours can be similar, and those into parts
    band = F.floor(F.log("n") / (math.log(1 / t) * (1 + 1e-9))).cast("int")
    bands = suspects.groupBy("group", band.alias("band")).agg(F.sum("n").alias("tokens"), F.count("*").alias("sets"))
    parts = F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("tokens") / GROUP_TOKENS).alias("parts"))))
    plan = bands.groupBy("group").agg(F.sum("sets").alias("sets"), F.when(F.sum("tokens") > GROUP_TOKENS, parts).alias("parts"))
    suspects = kept(spread_join(suspects.withColumn("band", band), kept(plan), "group", "sets"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, "text", SLICE):
            grams, edges_ = shingle_sets(*text_arrays(part.column(1)), n)
            raw = grams.tobytes()
            sets = [raw[8 * a : 8 * b] for a, b in zip(edges_[:-1].tolist(), edges_[1:].tolist(), strict=True)]
            own = pa.array(signatures(grams, edges_) == part.column(2).to_numpy())
            part, sets = part.filter(own), pa.array(sets, pa.binary()).filter(own)
            yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], sets], ["doc_id", "sign", "group", "band", "parts", "grams"])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, "text", SLICE):
            own = signatures(*shingle_sets(*text_arrays(part.column(1)), n))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own)], ["doc_id", "text", "sign"])

    # equal ids with different texts: the set of the class is told by its signature
    picked = suspects.select("doc_id", "sign", "group", "band", "parts")
    few = F.broadcast if suspects.count() <= _common.BROADCAST_ROWS else lambda frame: frame
    spelt = docs.join(few(picked), "doc_id").select("doc_id", "text", "sign", "group", "band", "parts")
    nameless = picked.where("doc_id is null").drop("doc_id")
    if not nameless.isEmpty():  # classes of rows without ids are bridges too: their texts are found by the signature
        told_ = docs.where("doc_id is null").mapInArrow(sign, "doc_id long, text string, sign long")
        spelt = spelt.unionByName(told_.join(few(nameless), "sign").dropDuplicates(["sign"]).select(spelt.columns))
    spelt = spelt.mapInArrow(spell, "doc_id long, sign long, `group` long, band int, parts map<int,bigint>, grams binary")
    own = F.pmod(F.xxhash64("sign"), F.col("parts")[F.col("band")])
    place = lambda i_band, i, j_band, j: F.struct(i_band.alias("i_band"), i.alias("i"), j_band.alias("j_band"), j.alias("j"))

    def meeting(step: int, pair) -> Column:
        """Pairs of the set's part with all parts of its band or of a band beside it."""
        n = F.coalesce(F.try_element_at("parts", F.col("band") + step), F.lit(0).cast("long"))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), pair)).otherwise(F.array())

    here, one = F.col("band"), F.lit(-1)
    pairs = F.concat(
        meeting(0, lambda j: place(here, F.least(own, j), here, F.greatest(own, j))),
        meeting(1, lambda j: place(here, own, here + 1, j)),
        meeting(-1, lambda j: place(here - 1, j, here, own)),
    )
    nought = F.lit(0).cast("long")
    pair = F.explode(F.when(F.col("parts").isNull(), F.array(place(one, nought, one, nought))).otherwise(pairs)).alias("pair")
    spelt = spelt.select("sign", "group", pair, "grams").select("sign", "group", "pair.*", "grams")

    def walk(table: pa.Table) -> pa.Table:
        names, raws = table.column("sign").to_pylist(), table.column("grams").to_pylist()
        sets = dict(zip(names, raws, strict=True))
        keys = sorted(sets)
        arrays = [np.frombuffer(sets[k], np.uint64) for k in keys]
        root = link_group(arrays, t)
        moved = [i for i, r in enumerate(root) if i != r]
        return pa.table({"a": pa.array([keys[i] for i in moved], pa.int64()), "b": pa.array([keys[root[i]] for i in moved], pa.int64())})

    links = kept(spelt.groupBy("group", "i_band", "i", "j_band", "j").applyInArrow(walk, "a long, b long"))
    if links.isEmpty():
        found = classes.select("sign", F.col("doc_id").alias("component_id")).where("false")
    else:
        labels = components(links)
        own = classes.join(labels, classes["sign"] == labels["node"]).select("sign", "doc_id", "label")
        least = own.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("sets"))
        found = spread_join(own, kept(least), "label", "sets").select("sign", "component_id")
    return _joined(members, classes, found)


def _joined(members: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """Every member with its component; only classes of several members or links are joined."""
    own = classes.join(found, "sign", "left").select("sign", "doc_id", "copies", F.coalesce("component_id", "doc_id").alias("component_id"))
    several = kept(own.where((F.col("copies") > 1) | ~F.col("component_id").eqNullSafe(F.col("doc_id"))).select("sign", "copies", "component_id"))
    full = spread_join(members.where("n > 0"), several, "sign", "copies", "left").select("doc_id", "n", "component_id")
    blank = members.where("n = 0").select("doc_id", "n", F.lit(None).cast("long").alias("component_id"))
    return full.unionByName(blank).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


_PACKET_SCHEMA = "key long, packet long, a binary, b binary, c binary, d binary, e binary"
_PACKET = [x.split()[0] for x in _PACKET_SCHEMA.split(", ")]
_FIRST = "bucket long, grams binary, nodes binary, lows binary, highs binary, a long, b long"
_NAMES = ["bucket", "grams", "nodes", "lows", "highs", "a", "b"]


def _taken(parts: list[np.ndarray]) -> np.ndarray:
    """The parts as one array; the list is empty then, so that no part is held twice for long."""
    whole = np.concatenate(parts)
    parts.clear()
    return whole


def _by_bucket(marks: list[np.ndarray], buckets: list[np.ndarray], owners: list[np.ndarray], packet: int) -> Iterator[pa.RecordBatch]:
    """A packet's fingerprints and their owners' differences, a row a bucket, in batches of some ``PORTION`` fingerprints; takes what the lists hold."""
    bucket = _taken(buckets)
    order = np.argsort(bucket, kind="stable").astype(np.uint32)
    bucket = bucket[order]
    edge = np.flatnonzero(np.r_[True, np.diff(bucket) != 0, True]) if len(order) else np.zeros(1, np.int64)
    names = bucket[edge[:-1]]
    del bucket
    mark, to = _taken(marks)[order], _taken(owners)[order]
    del order
    begin = 0
    while begin < len(names):
        end = max(begin + 1, int(np.searchsorted(edge, edge[begin] + PORTION, "right")) - 1)
        spans = list(zip(edge[begin:end].tolist(), edge[begin + 1 : end + 1].tolist(), strict=True))
        whom = [np.diff(to[i:j], prepend=np.uint16(0)).tobytes() for i, j in spans]
        yield _packets(names[begin:end].tolist(), packet, [[mark[i:j].tobytes() for i, j in spans], whom, *[[None] * len(spans)] * 3])
        begin = end


def _packets(keys: list[int], packet: int, columns: list[list]) -> pa.RecordBatch:
    values = [pa.array(keys, pa.int64()), pa.array([packet] * len(keys), pa.int64()), *(pa.array(c, pa.binary()) for c in columns)]
    return pa.RecordBatch.from_arrays(values, _PACKET)


def _table(batches: list[pa.RecordBatch]) -> pa.Table:
    kinds = [pa.int64(), *[pa.binary()] * 4, pa.int64(), pa.int64()]
    return pa.Table.from_batches(batches, pa.schema(list(zip(_NAMES, kinds, strict=True))))


def _edges(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(a):
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        empty = pa.nulls(len(a), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), -1 - task)), empty, empty, empty, empty, pa.array(a), pa.array(b)], _NAMES)


def _postings(bucket: np.ndarray, gram: np.ndarray, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row a bucket, with its postings as packed arrays."""
    order = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True])
    spans = list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))
    packed = [pa.array([x[order[i:j]].tobytes() for i, j in spans], pa.binary()) for x in (gram, node, low, high)]
    none = pa.nulls(len(spans), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(bucket[order[edge[:-1]]]), *packed, none, none], _NAMES)
