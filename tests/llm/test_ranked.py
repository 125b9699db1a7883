"""Ranked lexical search against scores worked out for every item and document."""

import math
import random
import re

import numpy as np
import pytest

from leadloom.llm import ranked as R

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs, items, top=10):
    kept = [(d, terms(t)) for d, t in docs if terms(t)]
    n, total = len(kept), sum(len(t) for _, t in kept)
    out = []
    for item, text in dict.fromkeys(items):
        wanted = set(terms(text))
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in x for _, x in kept) + 1))) for t in wanted}
        scores = []
        for d, x in kept:
            m = 100 - 90 + 90 * len(x) * n // total
            s = sum(w[t] * (1_000_000_000 * x.count(t) // (1000 * x.count(t) + 8 * m)) for t in wanted)
            scores += [(-s, d is not None, d, d)] if s > 0 else []
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=repr)


def found(spark, docs, items, parts=3, **more):
    frame = spark.createDataFrame([(*d, 1, 2.0, "x") for d in docs], "doc_id long, text string, score long, norm double, terms string").repartition(parts)
    return sorted(map(tuple, R.search(frame, spark.createDataFrame(items, "item_id long, text string"), **more).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_search_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(R, "LONGEST", 5)
    rng = random.Random(seed)
    words = [w for w in ("the of and é ÉA Ünï a1 B2 b2 x-y tail it's 日本 q_r".split() + [f"w{k}" for k in range(60)])]
    say = lambda n: " ".join(rng.choice(words[: rng.choice([5, 20, 75])]) for _ in range(n))
    docs = [(k, say(rng.choice([0, 1, 3, 30, 200]))) for k in range(120)] + [(None, say(9)), (None, None), (3, ""), (3, "the of"), (3, "the of")]
    docs += [(500 + k, "the hot hot copy w1 w2") for k in range(60)] + [(900, "w3 " * 60_000 + "z" * 1_200_000)]
    items = [(k, say(rng.choice([0, 1, 4, 40]))) for k in range(25)] + [(1, "w1 w2"), (1, "w1 w2"), (7, None), (8, "nowhere"), (9, "copy hot"), (10, "w3"), (None, "w4 the")]
    want = by_hand(docs, items)
    assert found(spark, docs, items) == want
    assert found(spark, docs, items, parts=1, block_chars=300) == want


def test_bounds_leave_out_nothing_that_counts():
    rng = np.random.default_rng(4)
    n, n_terms = 300, 50
    sizes = rng.integers(1, 20, n)
    ts = [np.sort(rng.choice(n_terms, s, replace=False)) for s in sizes]
    first, flat = np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(ts)
    impacts = rng.integers(1, 10**6, len(flat)) * rng.integers(1, 4000, n_terms)[flat]
    norms = np.sqrt(np.add.reduceat(impacts.astype(float) ** 2, first[:-1]))
    bucket, pruned = R.Bucket(np.arange(n), first, flat, impacts, norms, n_terms), 0
    for _ in range(40):
        query = rng.choice(n_terms, 8, replace=False)
        scores = np.array([impacts[a:b][np.isin(flat[a:b], query)].sum() for a, b in zip(first, first[1:], strict=False)])
        least = int(np.sort(scores)[-10])
        left = bucket.may_reach(query, least)
        assert set(np.flatnonzero(scores >= max(least, 1))) <= set(left)
        assert (bucket.scores(left, query, n_terms) == scores[left]).all()
        pruned += n - len(left)
    assert pruned > 40 * n / 3


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")], parts=1) == [] and found(spark, [(1, "a")], [], parts=1) == []
    assert found(spark, [(1, None), (2, "-")], [(1, "a")], parts=1) == [] and found(spark, [(1, "a"), (2, "b c")], [(1, "d")], parts=1) == []
    assert found(spark, [(1, "a")], [(1, "A")], parts=1) == by_hand([(1, "a")], [(1, "A")])
