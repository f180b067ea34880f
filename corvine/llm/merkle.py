"""Merkle manifest of a table: proofs and a root from sparse forests that merge in any order.

Rows become leaves by SQL functions over their columns; only digests move from there on.  Leaves are dealt
by ranges of (group, order) and sorted, so a partition is a stretch of one tree or of several, and three numbers a
partition say where it lies.  A partition folds all runs of ``ARITY`` siblings that it holds whole; what is
left is its *fragment*: a few nodes at either end of each level, keyed by tree, level and index.  Fragments are a
commutative monoid: the union of two completes the runs whose siblings have all arrived, as the widths of
the trees tell how many those are.  ``treeReduce`` adds them up to the root.  Runs that only a merge
completed are the *spine*; with it, each partition proves its own leaves.

The spine has at most ``7 * levels`` runs a partition, and partitions are at most ``MOST_PARTS``, so it and all fragments
are bounded; it is broadcast.  Leaves are checkpointed before and after they are sorted, so no executor's loss can change a rank.

Defined results: a null is encoded as ``-``, which no value is; null groups come first and null order keys come first in
their group; rows with equal keys are ordered by leaf, and equal rows are told apart by nothing but their place; a tree of one leaf is that leaf; an
empty table gives no rows and no root; columns that are not named are not read, so their names can clash with nothing.
Input rows must come in the same order when read again, as a scan's do; checkpoint others first.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import kept

ARITY, HEX = 8, 64
#: The tree over the subroots; other trees are numbered from 0 in the order of their groups.
TOP = -1
#: Leaves of a partition that are aimed at, and partitions at most; beyond, partitions hold more leaves.
PART_LEAVES, MOST_PARTS = 1 << 18, 8192


def digest(data: bytes) -> bytes:
    return sha256(data).hexdigest().encode()


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon, the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*(encoded(v) for v in values)), 256)


def width(leaves: int, level: int) -> int:
    for _ in range(level):
        leaves = -(-leaves // ARITY)
    return leaves


@dataclass
class Forest:
    """Nodes whose runs are not complete yet, the leaf counts of their trees, and the runs completed so far."""

    nodes: dict[tuple[int, int, int], bytes] = field(default_factory=dict)
    leaves: dict[int, int] = field(default_factory=dict)
    runs: dict[tuple[int, int, int], bytes] = field(default_factory=dict)
    roots: dict[int, bytes] = field(default_factory=dict)

    def add(self, tree: int, level: int, index: int, node: bytes) -> None:
        """Takes a node and folds all runs that it completes."""
        while True:
            if (wide := width(self.leaves[tree], level)) == 1:
                self.roots[tree] = node
                if tree == TOP:
                    return
                tree, level, index = TOP, 0, tree
                continue
            self.nodes[tree, level, index] = node
            run = index // ARITY
            of = [(tree, level, i) for i in range(run * ARITY, min((run + 1) * ARITY, wide))]
            if any(key not in self.nodes for key in of):
                return
            self.runs[tree, level, run] = joined = b"".join(self.nodes.pop(key) for key in of)
            level, index, node = level + 1, run, digest(joined)

    def stretch(self, tree: int, at: int, nodes: bytes) -> list[tuple[int, bytes]]:
        """Takes consecutive leaves of a tree; gives the stretches of nodes by level, each with its first index."""
        out, level = [], 0
        while True:
            out.append((at, nodes))
            n, wide = len(nodes) // HEX, width(self.leaves[tree], level)
            first, last = -(-at // ARITY), (-(-wide // ARITY) if at + n == wide else (at + n) // ARITY)
            whole = wide > 1 and last > first
            for i in (*range(at, first * ARITY), *range(last * ARITY, at + n)) if whole else range(at, at + n):
                self.add(tree, level, i, nodes[(i - at) * HEX : (i - at + 1) * HEX])
            if not whole:
                return out
            cut = [(k * ARITY - at) * HEX for k in range(first, last + 1)]
            nodes = b"".join(digest(nodes[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True))
            at, level = first, level + 1

    def merged(self, other: Forest) -> Forest:
        """The sum of two forests; which is taken into which does not change it."""
        small, large = sorted((self, other), key=lambda f: len(f.nodes) + len(f.runs))
        large.leaves |= small.leaves
        large.runs |= small.runs
        large.roots |= small.roots
        for key, node in small.nodes.items():
            large.add(*key, node)
        return large


@dataclass(frozen=True)
class Stretch:
    """Where a partition's leaves lie: the number of its first group, the first leaf's rank there, the leaf counts of its first and last group."""

    tree: int
    at: int
    first: int
    last: int


def place(parts: list[tuple]) -> tuple[dict[int, Stretch], int]:
    """Places partitions, given as (number, first group, its rows, last group, its rows, groups) in order; also the number of groups."""
    totals: dict[bytes, int] = {}
    for _, a, n, b, m, groups in parts:
        totals[a] = totals.get(a, 0) + n
        if groups > 1:
            totals[b] = totals.get(b, 0) + m
    out, tree, at, before = {}, -1, 0, None
    for number, a, n, b, m, groups in parts:
        if a != before:
            tree, at = tree + 1, 0
        out[number] = Stretch(tree, at, totals[a], totals[b])
        tree, at, before = tree + groups - 1, (m if groups > 1 else at + n), b
    return out, tree + 1


def runs_of(keys: pa.ChunkedArray) -> np.ndarray:
    """Edges of the stretches of equal keys."""
    same = keys.combine_chunks()
    return np.r_[0, np.flatnonzero(np.asarray(pc.not_equal(same[1:], same[:-1]))) + 1, len(same)]


def hexes(column: pa.ChunkedArray) -> bytes:
    """The digests of a binary column without nulls as one hex text."""
    return b"".join(column.to_pylist()).hex().encode()


def grown(table: pa.Table, spot: Stretch, groups: int) -> tuple[Forest, list[tuple[int, int, list]]]:
    """The forest of one partition and, for each of its trees, the first row and the stretches by level."""
    forest, levels, edges = Forest(leaves={TOP: groups}), [], runs_of(table.column("grp"))
    last = len(edges) - 2
    for j, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        tree = spot.tree + j
        forest.leaves[tree] = spot.first if j == 0 else spot.last if j == last else b - a
        levels.append((tree, a, forest.stretch(tree, spot.at if j == 0 else 0, hexes(table.column("leaf").slice(a, b - a)))))
    return forest, levels


class Paths:
    """Runs of siblings from a leaf to the root, from a partition's own nodes where it holds the run, else from its forest or the spine."""

    def __init__(self, forest: Forest, spine: dict, groups: int) -> None:
        self.forest, self.spine, self.groups = forest, spine, groups

    def run(self, tree: int, level: int, run: int, own: list) -> bytes:
        if level < len(own):
            at, nodes = own[level]
            a, b = run * ARITY, min((run + 1) * ARITY, width(self.forest.leaves[tree], level))
            if at <= a and b <= at + len(nodes) // HEX:
                return nodes[(a - at) * HEX : (b - at) * HEX]
        key = (tree, level, run)
        return self.forest.runs[key] if key in self.forest.runs else self.spine[key]

    def tree(self, tree: int, index: int, own: list, level: int = 0) -> list[tuple[bytes, int]]:
        """(run, place in it) at each level below the tree's root."""
        out, wide = [], width(self.forest.leaves[tree], level)
        while wide > 1:
            out.append((self.run(tree, level, index // ARITY, own), index % ARITY))
            index, level, wide = index // ARITY, level + 1, -(-wide // ARITY)
        return out


def without(run: bytes, place: int) -> bytes:
    return run[: place * HEX] + run[(place + 1) * HEX :]


def fold(node: bytes, path: list[tuple[bytes, int]]) -> bytes:
    """The root that a leaf gives with the siblings of a path."""
    for run, place_ in path:
        node = digest(run[: place_ * HEX] + node + run[(place_ + 1) * HEX :])
    return node


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of a task as one table for each partition number in it."""
    if not (held := [b for b in batches if b.num_rows]):
        return
    table = pa.Table.from_batches(held)
    edges = runs_of(table.column("part"))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield table.column("part")[a].as_py(), table.slice(a, b - a)


@dataclass
class Manifest:
    """A table's leaves in order, where its partitions lie, the runs that span them, and the root (None if there are no rows)."""

    rows: DataFrame
    spots: dict[int, Stretch]
    groups: int
    spine: dict
    root: str | None

    def prove(self, paths: bool = False) -> DataFrame:
        """For each row ``order, leaf, subroot, root, proof_sha256, folded_root, verified``.

        ``proof_sha256`` is the digest of all siblings on the way up; ``folded_root`` is recomputed from the claimed leaf.  With
        ``paths``, ``path`` holds the siblings themselves: for each level the run's digests, with an empty string in the own place.
        """
        spark, root, groups = self.rows.sparkSession, (self.root or "").encode(), self.groups
        shared = spark.sparkContext.broadcast((self.spots, self.spine))
        order = self.rows.schema["ord"].dataType.simpleString()
        schema = f"ord {order}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (", path array<array<string>>" if paths else "")

        def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            spots, spine = shared.value
            for number, table in by_part(batches):
                forest, levels = grown(table, spots[number], groups)
                edges = [first for _, first, _ in levels] + [table.num_rows]
                walk = Paths(forest, spine, groups)
                for (tree, first, own), end in zip(levels, edges[1:], strict=True):
                    top = walk.tree(TOP, tree, [])
                    high = b"".join(without(r, p) for r, p in top)
                    subroot = forest.roots.get(tree)
                    at, nodes = own[0]
                    wanted = table.slice(first, end - first)
                    claims = wanted.column("claim").to_pylist()
                    for a in range(0, end - first, 8192):
                        out: dict[str, list] = {"proof_sha256": [], "folded_root": [], "path": []}
                        upper, run = None, None
                        for i in range(a, min(a + 8192, end - first)):
                            own_leaf, index = nodes[i * HEX : (i + 1) * HEX], at + i
                            if run != index // ARITY:
                                run = index // ARITY
                                whole = walk.tree(tree, index, own)
                                upper = b"".join(without(r, p) for r, p in whole[1:]) + high
                            lower = [(whole[0][0], index % ARITY), *whole[1:]] if whole else []
                            if subroot is None:
                                subroot = fold(own_leaf, lower)
                            out["proof_sha256"].append(sha256((without(*lower[0]) if lower else b"") + upper).hexdigest())
                            claim = own_leaf if claims[i] is None else claims[i].hex().encode()
                            out["folded_root"].append(fold(claim, lower + top).decode())
                            if paths:
                                out["path"].append([["" if j == p else r[j * HEX : (j + 1) * HEX].decode() for j in range(len(r) // HEX)] for r, p in lower + top])
                        n = len(out["folded_root"])
                        columns = {
                            "ord": wanted.column("ord").slice(a, n).combine_chunks(), "leaf": [nodes[i * HEX : (i + 1) * HEX].decode() for i in range(a, a + n)],
                            "subroot": [subroot.decode()] * n, "root": [root.decode()] * n, "proof_sha256": out["proof_sha256"], "folded_root": out["folded_root"],
                            "verified": [x.encode() == root for x in out["folded_root"]],
                        } | ({"path": pa.array(out["path"], pa.list_(pa.list_(pa.string())))} if paths else {})
                        yield pa.RecordBatch.from_pydict(columns)

        return self.rows.mapInArrow(prove, schema)


def manifest(docs: DataFrame, values: list[str], group: str, order: str, claimed: Callable[[DataFrame], Column] | None = None, part_leaves: int = PART_LEAVES, most_parts: int = MOST_PARTS) -> Manifest:
    """Folds ``docs`` into one tree a group and one over their subroots.

    ``values`` are the columns of a leaf in their order; ``claimed`` gives the leaf that somebody holds against the manifest (null: the true one).
    """
    claim = F.lit(None).cast("string") if claimed is None else claimed(docs)
    key = F.when(docs[group].isNull(), F.lit(b"")).otherwise(F.concat(F.lit(b"\x01"), docs[group].cast("string").cast("binary")))
    leaves = kept(docs.select(key.alias("grp"), docs[order].alias("ord"), F.unhex(leaf([docs[v] for v in values])).alias("leaf"), F.unhex(claim).alias("claim"), F.monotonically_increasing_id().alias("nth")))
    parts = min(max(1, -(-leaves.count() // part_leaves), docs.sparkSession.sparkContext.defaultParallelism), most_parts)
    keys = [F.col("grp"), F.col("ord").asc_nulls_first(), F.col("leaf"), F.col("nth")]
    rows = kept(leaves.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select(F.spark_partition_id().alias("part"), "grp", "ord", "leaf", "claim"))
    count = rows.groupBy("part", "grp").count().groupBy("part")
    ends = count.agg(F.min(F.struct("grp", "count")).alias("a"), F.max(F.struct("grp", "count")).alias("b"), F.count("*").alias("groups")).collect()
    spots, groups = place(sorted((r["part"], bytes(r["a"][0]), r["a"][1], bytes(r["b"][0]), r["b"][1], r["groups"]) for r in ends))
    if not spots:
        return Manifest(rows, {}, 0, {}, None)
    shared = docs.sparkSession.sparkContext.broadcast(spots)

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in by_part(batches):
            forest, _ = grown(table, shared.value[number], groups)
            named = {tree for tree, _, _ in forest.nodes} | {TOP}
            roots = {TOP: forest.roots[TOP]} if TOP in forest.roots else {}
            small = Forest(forest.nodes, {t: n for t, n in forest.leaves.items() if t in named}, {}, roots)
            yield pa.RecordBatch.from_pydict({"forest": pa.array([pickle.dumps(small)], pa.binary())})

    made = rows.select("part", "grp", "leaf").mapInArrow(fragments, "forest binary")
    whole = made.rdd.map(lambda r: pickle.loads(r["forest"])).treeReduce(Forest.merged)
    return Manifest(rows, spots, groups, whole.runs, whole.roots[TOP].decode())
