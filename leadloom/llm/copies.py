"""SimHash near-dedup at five words and a similarity of 0.8: trees in shards of rare shingles, links checked on the sets.

A document is the set of its runs of five words (the whole text where it is shorter); rows with equal sets are one node. Two
documents link if their sets have a Jaccard similarity of 0.8 or more. At that similarity fingerprints differ in about 10 of 64
bits, too many for blocks of equal bits as in ``simhash``, so shards are made of content:

* a node without a partner in any of 40 bands of 5 minimum hashes is done (a pair at 0.8 shares none with a probability of
  1.2e-7, and less above it);
* the others meet in shards of one shingle each: with shingles ordered rarest first, two sets that link share one of their first
  n - ceil(0.8 n) + 1, and enough shingles are left after the first one they share. Both hold for every link.

In each shard all nodes are first compared with the one that has the fewest shingles of its own, as copies lie round their
source. After that only nodes of different components meet, through BK-trees of their SimHash fingerprints, along edges within
``RADIUS``. A shard is cut into trees of bounded size and its nodes are sent to each of them. Every candidate is checked on the
sets, so nothing links by its fingerprint alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from . import words as W
from .common import components, saved
from .simhash import LOWER, Tree

SHINGLE = 5
#: Similarity of 4 fifths, kept as integers so that the check is exact.
PARTS, OF = 4, 5
#: Bits in which fingerprints of a link may differ. At 0.8 they differ in 9.7 on average, by 2.9 (one standard deviation), and in
#: sets of five shingles by 12 and 3.1, so that more than this is rarer than one in 100,000 links of long texts.
RADIUS = 24
BANDS, ROWS = 40, 5
SALTS = np.random.default_rng(42).integers(0, 1 << 64, (BANDS * ROWS, 2), np.uint64) | np.uint64(1)
#: Nodes in a tree; a shard with more has several.
TREE_SIZE = 4096


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Per text, the distinct 64-bit hashes of its shingles, sorted. No words: none."""
    for a, b in W.pieces(texts):
        words = W.Words([t.translate(LOWER) for t in texts[a:b]])
        h = words.hashes()
        for i, j in zip(words.first[:-1], words.first[1:], strict=True):
            yield np.unique(W.windows(h[i:j], min(size, j - i))) if j > i else np.zeros(0, np.uint64)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """Bands of minimum hashes of non-empty sets, a row of ``BANDS`` keys each."""
    h = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.zeros((len(sets), BANDS), np.uint64)
    for k, (mask, factor) in enumerate(SALTS):
        out[:, k // ROWS] = out[:, k // ROWS] * W.U(W.P) + np.minimum.reduceat((h ^ mask) * factor, starts)
    return W.mix(out + np.arange(BANDS, dtype=np.uint64) * W.U(W.BASES[0]))


def _keys(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) -> (doc_id, node: a hash of the set, its bands)."""
    for batch in batches:
        ids, texts = batch.column(0), W.texts_of(batch.column(1))
        for a, b in W.pieces(texts):
            sets = list(shingle_sets(texts[a:b]))
            bands = np.zeros(0, np.int64) if not any(map(len, sets)) else band_keys([s for s in sets if len(s)]).view(np.int64).ravel()
            ends = np.concatenate([[0], np.cumsum([BANDS * (len(s) > 0) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(_keys(sets)), pa.ListArray.from_arrays(pa.array(ends), pa.array(bands))], ["doc_id", "node", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> (node, fingerprint, shingles)."""
    for batch in batches:
        texts = W.texts_of(batch.column(0))
        for a, b in W.pieces(texts):
            sets = list(shingle_sets(texts[a:b]))
            fps = np.array([simhash.majority(s) for s in sets], np.uint64).view(np.int64)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            shingles = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(_keys(sets)), pa.array(fps), shingles], ["node", "fp", "shingles"])


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs ``(a, b)``, those whose sets reach the similarity: both * OF >= PARTS * either."""
    side = lambda node, name: sets.select(F.col("node").alias(node), F.col("shingles").alias(name))
    met = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    both = F.size(F.array_intersect("x", "y"))
    return met.where(both * (OF + PARTS) >= (F.size("x") + F.size("y")) * PARTS).select("a", "b")


def _can_reach(n: str, at: str, m: str, at2: str) -> Column:
    """Whether sets of n and m shingles whose first common one is at these places (from 1) can have the similarity."""
    return (1 + F.least(F.col(n) - F.col(at), F.col(m) - F.col(at2))) * (OF + PARTS) >= (F.col(n) + F.col(m)) * PARTS


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, tree, guest, node, fp, n, at, component), sorted by the first three -> candidates (a, b); holds one tree at a time."""
    key, tree, members = None, Tree(), []
    for batch in batches:
        found: list[tuple[int, int]] = []
        for shard, number, guest, node, fp, n, at, component in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (shard, number) != key:
                key, tree, members = (shard, number), Tree(), []
            fp &= 0xFFFFFFFFFFFFFFFF
            for i, _ in tree.within(fp, RADIUS):
                node2, n2, at2, component2 = members[i]
                if component2 != component and (1 + min(n - at, n2 - at2)) * (OF + PARTS) >= (n + n2) * PARTS:
                    found.append((node, node2))
            if not guest:
                tree.add(fp)
                members.append((node, n, at, component))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])


def tree_pairs(left: DataFrame, sizes: DataFrame, tree_size: int = TREE_SIZE) -> DataFrame:
    """Candidates ``(a, b)`` of ``left(shingle, node, fp, n, at, component)``: of different components, near by fingerprint, and able to link.

    ``sizes(shingle, m)`` gives the nodes of each shard. A node is a member of one tree of its shard and a guest in the next half of
    the others, going round, so that every two trees meet and all have the same work.
    """
    trees = F.ceil(F.col("m") / tree_size).cast("int")
    rows = left.join(sizes, "shingle").withColumns({"own": F.pmod(F.col("node"), trees).cast("int"), "trees": trees})
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(0), F.floor(F.col("trees") / 2).cast("int"))))
    rows = rows.withColumns({"tree": F.pmod(F.col("own") + F.col("step"), F.col("trees")), "guest": F.col("step") > 0})
    rows = rows.select("shingle", "tree", "guest", "node", "fp", "n", "at", "component").repartition("shingle", "tree").sortWithinPartitions("shingle", "tree", "guest", "node")
    return rows.mapInArrow(_search, "a long, b long")


def links(sets: DataFrame, tree_size: int = TREE_SIZE) -> DataFrame:
    """Links ``(a, b)`` that connect every two of ``sets(node, fp, shingles)`` with the similarity, directly or through others.

    What is joined by shingle or node is saved first, so that the rows of a hot one can be split.
    """
    tokens = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    shared = saved(tokens.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"), "copies-df")
    common = saved(tokens.join(shared, "shingle"), "copies-common")
    order = Window.partitionBy("node").orderBy("df", "shingle")
    ranked = common.withColumn("rank", F.row_number().over(order)).withColumn("own", F.col("n") - F.count("*").over(Window.partitionBy("node")))
    # A node's own shingles come first in its order and meet nobody.
    prefix = F.col("n") - F.ceil(F.col("n") * PARTS / OF) + 1
    first = saved(ranked.withColumn("at", F.col("own") + F.col("rank")).where(F.col("at") <= prefix).select("shingle", "node", "n", "own", "at"), "copies-prefix")
    hubs = saved(first.groupBy("shingle").agg(F.min(F.struct("own", "node", "n", "at")).alias("hub"), F.count("*").alias("m")).where("m > 1").select("shingle", "hub"), "copies-hubs")
    spokes = first.join(hubs, "shingle").where((F.col("node") != F.col("hub.node")) & _can_reach("n", "at", "hub.n", "hub.at"))
    stars = saved(_alike(spokes.select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct(), sets), "copies-stars")
    groups = saved(components(stars, "copies-groups"), "copies-groups")
    at = first.join(groups, "node", "left").select("shingle", "node", "n", "at", F.coalesce("component", "node").alias("component"))
    mixed = at.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m")).where("lo <> hi")
    sizes = saved(mixed.select("shingle", "m"), "copies-shards")
    left = saved(at.join(sizes.select("shingle"), "shingle").join(sets.select("node", "fp"), "node"), "copies-left")
    return stars.union(_alike(tree_pairs(left, sizes, tree_size).distinct(), sets))


def near_copies(docs: DataFrame, text: str = "text", tree_size: int = TREE_SIZE) -> DataFrame:
    """``(doc_id, component_id)`` per row of ``docs``, the component being the smallest doc_id reached by links.

    Null and empty texts share the empty set. Rows that share a doc_id count as one node. A null doc_id takes no part as a
    node: its row gets the component of its set, null if it is alone there. Extra columns of ``docs`` are ignored; an empty
    table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    told = saved(rows.mapInArrow(_described, "doc_id long, node long, bands array<long>"), "copies-bands")
    nodes = saved(told.where("doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.any_value("bands").alias("bands")), "copies-node")
    banded = nodes.select("node", "doc_id", F.explode("bands").alias("band"))
    met = saved(banded.groupBy("band").agg(F.count("*").alias("m")).where("m > 1").select("band"), "copies-met")
    found = saved(banded.join(met, "band", "left_semi").select("node", "doc_id").distinct(), "copies-found")
    texts = rows.join(found.select("doc_id").distinct(), "doc_id", "left_semi").select("text")
    # A repeated doc_id brings other texts along.
    sets = saved(texts.mapInArrow(_sets, "node long, fp long, shingles array<long>").join(found, "node", "left_semi").dropDuplicates(["node"]), "copies-sets")
    known = nodes.select("node", "doc_id")
    linked = links(sets, tree_size).join(known.toDF("a", "x"), "a").join(known.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    # A node stands for its smallest doc_id; rows that share a doc_id join their sets.
    same = told.where("doc_id is not null").select("doc_id", "node").distinct().join(known.toDF("node", "least"), "node").select("doc_id", "least")
    ends = same.groupBy("doc_id").agg(F.min("least").alias("lo"), F.max("least").alias("hi")).where("lo <> hi").select("doc_id", "lo")
    twice = same.join(saved(ends, "copies-twice"), "doc_id").where("least <> lo").select(F.col("least").alias("a"), F.col("lo").alias("b"))
    groups = components(linked.union(twice), "copies-links")
    at = saved(known.join(groups.toDF("doc_id", "component"), "doc_id", "left").select("node", F.coalesce("component", "doc_id").alias("component_id")), "copies-at")
    return told.select("doc_id", "node").join(at, "node", "left").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one document of each group, as ``simhash.one_of_each``."""
    return simhash.one_of_each(docs, text, near_copies(docs, text))
