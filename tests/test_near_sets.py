"""The set-similarity join on sets of many sizes, and what it compares of a large block."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from leadloom.operators import dedup as D


def test_sets_of_all_sizes_equal_brute_force(spark):
    rng = random.Random(5)
    sets = {}
    for v in range(260):
        first = [f"w{rng.randrange(80)}" for _ in range(rng.randrange(1, 70))]
        sets[v] = set(first)
        if v % 3 and v > 5:  # near an earlier one: some left out, some new
            old = sorted(sets[rng.randrange(v)])
            sets[v] = {x for x in old if rng.random() < 0.85} | {f"w{rng.randrange(80)}" for _ in range(rng.randrange(4))} or {"w1"}
    frame = spark.createDataFrame([(1, v, sorted(s)) for v, s in sets.items()], "group long, value long, grams array<string>")
    for t in (0.6, 0.8):
        want = sorted((1, a, b) for a, x in sets.items() for b, y in sets.items() if a < b and len(x & y) >= t * len(x | y) - 1e-12)
        assert len(want) > 20 and sorted(map(tuple, D.near_sets(frame, t).collect())) == want


def test_common_grams_are_no_keys_of_sets_of_one_size(spark):
    """Numbered users of one name: the gram of the first digit, which a ninth of them has, is a key only towards shorter users."""
    rng = random.Random(6)
    users = [f"john.smith{k}" for k in rng.sample(range(100000, 900000), 3000)]
    sets = [sorted({u[k : k + 3] for k in range(len(u) - 2)}) for u in users]
    counts = Counter(g for s in sets for g in s)
    prefixes = Counter(g for s in sets for g in sorted(s, key=lambda g: (counts[g], g))[: len(s) - math.ceil(0.6 * len(s)) + 1])
    pairs = sum(n * (n - 1) // 2 for n in prefixes.values())  # with prefixes by a set's own size only
    rows = spark.createDataFrame([(1, v, s) for v, s in enumerate(sets)], "group long, value long, grams array<string>")
    met = D.near_keys(rows).groupBy("group", "gram", "low", "high").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]
    print(f"pairs met: {met:.0f}, by the set's own size only: {pairs}")
    assert met < pairs / 2
