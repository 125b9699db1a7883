"""SimHash near-duplicates with BK-trees.

Distinct fingerprints are dealt into blocks that share two of four 16-bit bands: two fingerprints that differ in at most
two bits agree in at least two bands, so every link lies inside a block. Each block gets a BK-tree (children keyed by
Hamming distance to their parent) which is searched along the edges within the radius. A block with more fingerprints than a
tree should hold is dealt again by two of four bands of the bits that its members need not share, first 32, then 16; after
that only 8 bits are left, so no tree can hold more than 256. The same argument keeps every link at each step.

The trees travel with their blocks rather than by broadcast: together they grow with the corpus. ``copies`` uses the same
trees for five-word shingles and a similarity of 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .common import components, saved, table

RADIUS = 2
TREE_SIZE = 4096
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
VOTES = 1 << 14


def majority(hashes: np.ndarray) -> int:
    """64 bits: 1 where over half of the hashes have a 1; none: 0."""
    votes = np.zeros(64, np.int64)
    for a in range(0, len(hashes), VOTES):
        votes += np.unpackbits(hashes[a : a + VOTES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """SimHash by the shingles' XXH64. No words: 0. Repeats of a shingle count each time."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined, hash64 = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(shingle, len(words))
    stop = ends[k - 1 :]
    start = np.concatenate([[0], ends[: len(words) - k] + 1])
    return majority(np.fromiter((hash64(joined[s:e], seed) for s, e in zip(start.tolist(), stop.tolist(), strict=True)), np.uint64, len(stop)))


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)`` per row of ``docs``; fp holds the 64 bits as a signed long. One pass over the texts, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in W.texts_of(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


class Tree:
    """A BK-tree over 64-bit fingerprints: the children of a node are keyed by their Hamming distance to it."""

    def __init__(self) -> None:
        self.fps: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, fp: int, radius: int) -> Iterator[tuple[int, int]]:
        """Place and distance of all nodes within the radius; only edges that can lead to some are followed."""
        stack = [0] if self.fps else []
        while stack:
            j = stack.pop()
            d = (self.fps[j] ^ fp).bit_count()
            if d <= radius:
                yield j, d
            stack += [child for key, child in self.children[j].items() if d - radius <= key <= d + radius]

    def add(self, fp: int) -> None:
        at, j = len(self.fps), 0
        self.fps.append(fp)
        self.children.append({})
        while at:
            d = (self.fps[j] ^ fp).bit_count()
            if (child := self.children[j].get(d)) is None:
                self.children[j][d] = at
                return
            j = child


def tree_links(fps: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that hold the block's fingerprints together, as index pairs: a forest, not all pairs.

    Each fingerprint searches the tree of those before it, and is joined to each group it touches once.
    """
    root, tree, links = list(range(len(fps))), Tree(), []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, x in enumerate(fps):
        for j, _ in tree.within(x, radius):
            if (a := top(i)) != (b := top(j)):
                root[a] = b
                links.append((i, j))
        tree.add(x)
    return links


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, fp, node) sorted by block -> links (a, b) of nodes; holds one block at a time."""
    block, fps, ids = None, [], []

    def links() -> pa.RecordBatch:
        found = tree_links(fps)
        return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in found], pa.int64()), pa.array([ids[j] for _, j in found], pa.int64())], ["a", "b"])

    for batch in batches:
        for key, value, node in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != block:
                if len(fps) > 1:
                    yield links()
                block, fps, ids = key, [], []
            fps.append(value & 0xFFFFFFFFFFFFFFFF)
            ids.append(node)
    if len(fps) > 1:
        yield links()


PAIRS = [(i, j) for i in range(4) for j in range(i + 1, 4)]


def _split(free: Column, bits: int) -> Column:
    """The six ways to keep two of four bands of the ``bits`` free low bits: ``struct(kept, free)``, kept with the way's number.

    What is left free has half the bits.
    """
    w, full = bits // 4, (1 << bits // 4) - 1
    band = [F.shiftrightunsigned(free, w * k).bitwiseAND(F.lit(full)) for k in range(4)]
    ways = []
    for n, (i, j) in enumerate(PAIRS):
        k, m = (x for x in range(4) if x not in (i, j))
        kept = F.shiftleft(F.lit(n).cast("long"), 2 * w).bitwiseOR(F.shiftleft(band[i], w)).bitwiseOR(band[j])
        ways.append(F.struct(kept.alias("kept"), F.shiftleft(band[k], w).bitwiseOR(band[m]).alias("free")))
    return F.array(*ways)


def links(nodes: DataFrame, tree_size: int = TREE_SIZE) -> DataFrame:
    """Links ``(a, b)`` that connect every two ``nodes(fp, node)`` (distinct fp) within two bits, directly or through others."""
    trees, left, keys = [], nodes.withColumn("free", F.col("fp")), []
    for depth, bits in enumerate((64, 32, 16)):
        left = left.withColumn("way", F.explode(_split(F.col("free"), bits))).select("fp", "node", *keys, F.col("way.kept").alias(f"key{depth}"), F.col("way.free").alias("free"))
        keys.append(f"key{depth}")
        if depth:
            left = saved(left, "simhash-deeper")
        sizes = saved(left.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), "simhash-blocks")
        met = left.join(sizes, keys)
        if depth < 2:
            trees.append(met.where(F.col("n") <= tree_size))
            left = met.where(F.col("n") > tree_size).drop("n")
            if sizes.where(F.col("n") > tree_size).isEmpty():
                break
        else:
            trees.append(met)
    found = []
    for depth, part in enumerate(trees):
        block = F.xxhash64(*keys[: depth + 1])  # blocks with an equal hash share a tree, which finds no less
        rows = part.select(block.alias("block"), "fp", "node").repartition("block").sortWithinPartitions("block", "node")
        found.append(rows.mapInArrow(_search, "a long, b long"))
    return reduce(DataFrame.union, found)


def near_duplicates(docs: DataFrame, text: str = "text", shingle: int = 3, tree_size: int = TREE_SIZE) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` per row of ``docs``.

    Documents link if their fingerprints differ in at most two bits; the component is the smallest doc_id reached. Null or
    empty texts have fingerprint zero and link like any other. Rows that share a doc_id count as one node, so their
    components join. A null doc_id takes no part as a node: its row gets the component of its fingerprint, null if it is
    alone there. Extra columns of ``docs`` are ignored; an empty table gives no rows.
    """
    fps = saved(fingerprints(docs, text, shingle), "simhash-fp")
    nodes = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-node")
    known = nodes.where("node is not null")
    twice = fps.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("doc_id")
    same = fps.join(twice, "doc_id", "left_semi").join(nodes, "fp").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    groups = components(links(known, tree_size).union(same), "simhash-links")
    labels = nodes.join(groups, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(labels, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, text: str = "text", groups: DataFrame | None = None) -> DataFrame:
    """``docs`` with one document of each group: the one whose doc_id names the group. Rows without a doc_id stay."""
    groups = near_duplicates(docs, text) if groups is None else groups
    ids = groups.where("doc_id = component_id").select("doc_id").distinct()
    row = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(text)))
    kept = docs.join(ids, "doc_id", "left_semi").withColumn("__row", row).where("__row = 1")
    return kept.select(docs.columns).union(docs.where("doc_id is null"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
