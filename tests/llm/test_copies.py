"""The pipeline's near-dedup stage against brute-force Jaccard."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leadloom.llm import copies


def kept_by_hand(texts):
    """Smallest ids of the components of all pairs whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = {}
    for d, t in texts:
        words = (t or "").lower().encode().split()
        k = min(5, len(words))
        sets[d] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()
    ids = sorted(sets)
    root = {d: d for d in ids}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) > 0 and 5 * len(x & y) >= 4 * len(x | y):
                p, q = sorted((top(a), top(b)))
                root[q] = p
    return {top(d) for d in ids}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_stage_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    want = kept_by_hand([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == want


def test_groups_of_edited_copies(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(250):  # far copies link to nobody, near ones to their source, some only through others
        words = base[:]
        for _ in range(rng.choice([1, 1, 2, 3, 4, 5, 8, 12])):
            words[rng.randrange(120)] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    for i in range(60):  # a chain: the ends do not link themselves
        rows.append((1000 + i, " ".join(f"c{k}" for k in range(i, i + 100))))
    rows += [(2000, "a b c d e f g h i"), (2001, "a b c d e f g h"), (2002, "a b"), (2003, "A  B"), (2004, ""), (2005, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in copies.one_of_each(docs).collect()} == kept_by_hand(rows)


def test_small_trees_find_the_same(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        words = base[:]
        for _ in range(rng.randrange(6)):
            words[rng.randrange(60)] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [{(r.doc_id, r.component_id) for r in copies.near_copies(docs, tree_size=n).collect()} for n in (7, 4096)]
    assert found[0] == found[1] and {c for _, c in found[0]} == kept_by_hand(rows)


def test_edges(spark):
    rows = [(1, "one two three"), (1, "four five six"), (2, "four five six"), (None, "one two three"), (None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in copies.near_copies(docs).where("doc_id is not null").collect()} == {1}
    assert sorted(str(r.component_id) for r in copies.near_copies(docs).where("doc_id is null").collect()) == ["1", "None"]
    assert copies.near_copies(docs.where(F.lit(False))).count() == 0
