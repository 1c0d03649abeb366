"""Near-duplicates by SimHash fingerprints, linked through vantage-point trees.

Two fingerprints link when at most ``max_bits`` of 64 bits differ. Over all 64
bits the distances of unrelated texts crowd around 32, and the bound of a
vantage point excludes little. The search therefore uses one tree for each of
``TREES`` blocks of bits: of four differing bits some block of three has at most
one, so every link is found in the tree of that block at radius one.

* A tree's nodes are vantage points with a distance; they are laid out on a
  bounded sample (``SAMPLE_ROWS``), and every fingerprint is sent down it.
* A fingerprint is stored in the one leaf it falls into. As a query it also goes
  to every leaf that the triangle bounds leave open, the boundary-overlapping
  shards. Leaves are groups of a shuffle; depth follows the number of rows.
* A leaf compares its queries with the fingerprints it stores on all 64 bits and
  returns each one's least linked fingerprint within the leaf, not the pairs, so
  a group of near copies costs its members and not their square.
* The links of all leaves become components by star contraction.

Copies share a fingerprint and enter the trees once.

Defined results: a null or empty text has fingerprint zero. Rows that share a
``doc_id`` are fingerprinted row by row. A null ``doc_id`` counts for no
component id; a component of nothing else has a null id. Empty tables give
empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoca.llm.common import ASCII_LOWER, as_bytes, slices, without
from convoca.llm.components import components
from convoca.sources.staging import stage

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
TREES = 3
# fingerprints that lay out the trees, and those aimed at in a leaf
SAMPLE_ROWS = 20_000
LEAF_ROWS = 512
MAX_DEPTH = 14
# shingles counted at once
AT_ONCE = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE_WORDS) -> int:
    """SimHash of a UTF-8 text as a signed 64-bit number."""
    words = (text or b"").translate(ASCII_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), AT_ONCE):
        hashes = b"".join(
            [
                xxhash.xxh64_digest(joined[a:b], SEED)
                for a, b in zip(starts[at : at + AT_ONCE].tolist(), ends[at : at + AT_ONCE].tolist(), strict=True)
            ]
        )
        bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = [fingerprint(text, shingle) for text in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


@dataclass
class Node:
    """Below ``limit`` of ``point`` lies ``near``, above it ``far``; a leaf has a number only."""

    leaf: int = -1
    point: int = 0
    limit: int = 0
    near: Node | None = None
    far: Node | None = None


@dataclass
class Tree:
    mask: int
    radius: int
    root: Node
    first_leaf: int
    leaves: int = 0

    def distances(self, fps: np.ndarray, point: int) -> np.ndarray:
        return np.bitwise_count((fps ^ np.uint64(point)) & np.uint64(self.mask)).astype(np.int64)

    def _grow(self, sample: np.ndarray, depth: int, rng: np.random.Generator) -> Node:
        best = None
        if depth and len(sample) >= 8:
            values = np.unique(sample & np.uint64(self.mask))
            for point in rng.choice(values, size=min(8, len(values)), replace=False).tolist():
                d = self.distances(sample, point)
                for limit in np.unique(np.quantile(d, [0.35, 0.5, 0.65], method="lower")).tolist():
                    near = int((d <= limit).sum())
                    if not 0.1 * len(d) <= near <= 0.9 * len(d):
                        continue
                    # rows that go both ways
                    both = int(((d > limit - self.radius) & (d <= limit + self.radius)).sum())
                    worth = max(near, len(d) - near) + both
                    if best is None or worth < best[0]:
                        best = (worth, point, int(limit), d <= limit)
        if best is None:
            self.leaves += 1
            return Node(leaf=self.first_leaf + self.leaves - 1)
        _, point, limit, inside = best
        return Node(
            point=point,
            limit=limit,
            near=self._grow(sample[inside], depth - 1, rng),
            far=self._grow(sample[~inside], depth - 1, rng),
        )

    def route(self, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, rows that visit it, whether the leaf is their own)."""
        todo = [(self.root, np.arange(len(fps)), np.ones(len(fps), dtype=bool))]
        while todo:
            node, rows, own = todo.pop()
            if not len(rows):
                continue
            if node.near is None:
                yield node.leaf, rows, own
                continue
            d = self.distances(fps[rows], node.point)
            near, far = d - self.radius <= node.limit, d + self.radius > node.limit
            inside = d <= node.limit
            todo.append((node.near, rows[near], (own & inside)[near]))
            todo.append((node.far, rows[far], (own & ~inside)[far]))


def grow(sample: np.ndarray, depth: int, max_bits: int = MAX_BITS, trees: int = TREES) -> list[Tree]:
    """One tree per block of bits, laid out on ``sample``."""
    rng, forest, first = np.random.default_rng(SEED), [], 0
    edges = [64 * k // trees for k in range(trees + 1)]
    for low, high in zip(edges, edges[1:], strict=False):
        tree = Tree(((1 << (high - low)) - 1) << low, max_bits // trees, Node(), first)
        tree.root = tree._grow(sample, depth, rng)
        first += tree.leaves
        forest.append(tree)
    return forest


def _visits(nodes: DataFrame, forest: list[Tree]) -> DataFrame:
    """(leaf, fp, own): every leaf a fingerprint has to be looked for in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)
            for tree in forest:
                leaves, rows, own = [], [], []
                for leaf, at, mine in tree.route(fps):
                    leaves.append(np.full(len(at), leaf, dtype=np.int32))
                    rows.append(at)
                    own.append(mine)
                if leaves:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate(leaves)),
                            pa.array(fps[np.concatenate(rows)].view(np.int64)),
                            pa.array(np.concatenate(own)),
                        ],
                        names=["leaf", "fp", "own"],
                    )

    return nodes.select("fp").mapInArrow(run, "leaf int, fp bigint, own boolean")


def _close(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Which of ``a`` have another fingerprint of ``b`` within ``max_bits``."""
    found = np.zeros(len(a), dtype=bool)
    step = max(1, (1 << 17) // max(1, len(b)))
    for at in range(0, len(a), step):
        d = np.bitwise_count(a[at : at + step, None] ^ b[None, :])
        found[at : at + step] = ((d <= max_bits) & (d > 0)).any(axis=1)
    return found


def link_leaf(stored: np.ndarray, asked: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(fp, least fp linked to it within the leaf) of the fingerprints that link at all."""
    asked = asked[_close(asked, stored, max_bits)] if len(stored) else asked[:0]
    stored = stored[_close(stored, asked, max_bits)] if len(asked) else stored[:0]
    names, roots = [], []
    while len(asked):
        # one component at a time; members leave the pool, so each is visited once
        members, frontier, ask_side = [asked[:1]], asked[:1], False
        asked = asked[1:]
        quiet = 0
        waiting = {True: frontier, False: frontier}
        while quiet < 2:
            pool = asked if ask_side else stored
            front = waiting[ask_side]
            waiting[ask_side] = pool[:0]
            hit = np.zeros(len(pool), dtype=bool)
            if len(front) and len(pool):
                step = max(1, (1 << 17) // len(pool))
                for at in range(0, len(front), step):
                    d = np.bitwise_count(front[at : at + step, None] ^ pool[None, :])
                    hit |= (d <= max_bits).any(axis=0)
            new = pool[hit]
            if ask_side:
                asked = asked[~hit]
            else:
                stored = stored[~hit]
            quiet = 0 if len(new) else quiet + 1
            if len(new):
                members.append(new)
                # a fingerprint found on one side is looked for from there
                waiting[not ask_side] = np.concatenate([waiting[not ask_side], new])
            ask_side = not ask_side
        group = np.unique(np.concatenate(members).view(np.int64))
        if len(group) > 1:
            names.append(group)
            roots.append(np.full(len(group), group[0]))
    if not names:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(names), np.concatenate(roots)


def links(nodes: DataFrame, max_bits: int = MAX_BITS, trees: int = TREES, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(a, b) edges whose components are those of all pairs of ``nodes`` (fp) within ``max_bits``."""
    rows = nodes.count()
    depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(1, rows) / leaf_rows)))))
    sample = nodes.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE_ROWS).toPandas()["fp"]
    forest = grow(sample.to_numpy(dtype=np.int64).view(np.uint64), depth, max_bits, trees)

    def compare(leaf: pd.DataFrame) -> pd.DataFrame:
        fps = leaf["fp"].to_numpy(dtype=np.int64).view(np.uint64)
        a, b = link_leaf(fps[leaf["own"].to_numpy(dtype=bool)], fps, max_bits)
        return pd.DataFrame({"a": a, "b": b})

    return _visits(nodes, forest).groupBy("leaf").applyInPandas(compare, "a bigint, b bigint")


def classes(prints: DataFrame, max_bits: int = MAX_BITS, **options) -> DataFrame:
    """``prints`` (doc_id, fp) with ``component_id``, the smallest doc_id reachable over links."""
    prints = stage(prints.select("doc_id", "fp"), "fingerprints")
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "fp-nodes")
    linked = components(links(nodes, max_bits, **options))
    linked = stage(linked, "fp-roots").withColumnRenamed("node", "fp")
    named = nodes.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = named.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    by_fp = stage(named.join(ids, "root").select("fp", "component_id"), "fp-classes")
    return prints.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def near_duplicate_classes(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, **options) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    return classes(fingerprints(docs, shingle), max_bits, **options)


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each class stays: all rows of its smallest doc_id.

    Rows without a doc_id stay as well, as nothing names the class's choice.
    """
    found = near_duplicate_classes(docs, shingle, max_bits)
    keep = found.filter("doc_id = component_id").select(F.col("doc_id").alias("__keep")).distinct()
    rows = without(docs)
    named = rows.join(keep, rows["doc_id"].cast("bigint") == keep["__keep"], "left_semi")
    return named.unionByName(rows.filter("doc_id is null"))
