"""Order MinHash fingerprints against a plain version of the same rules."""

import hashlib
import random
import re
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from leadloom.llm import order_minhash as O


def xx(*values):
    h = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<q", v) if isinstance(v, int) else struct.pack("<i", v[0])
        h = xxhash.xxh64_intdigest(data, seed=h)
    return h - (1 << 64) if h >> 63 else h


def print_by_hand(text):
    hs = [xx(w) for w in re.split("[ \t-\r]+", text) if w]
    if len(hs) >= 3:
        kmers = [xx(*hs[i : i + 3]) for i in range(len(hs) - 2)]
    else:
        acc = 3
        for h in hs:
            acc = xx(acc, h)
        kmers = [acc] if hs else []
    seen, cells = Counter(), {}
    for pos, k in enumerate(kmers):
        seen[k] += 1
        item = xx(k, (seen[k],))
        cells.setdefault(item % 64, []).append((item, pos, k))
    out = ""
    for c in range(64):
        acc = 64
        for _, _, k in sorted(sorted(cells.get(c, []))[:2], key=lambda x: x[1]):
            acc = xx(acc, k)
        out += f"{acc & 0xFFFFFFFF:08x}".upper() if c in cells else "-" * 8
    return out


def near(a, b):
    pairs = [(a[k : k + 8], b[k : k + 8]) for k in range(0, 512, 8)]
    used = [p for p in pairs if p != ("-" * 8, "-" * 8)]
    return sum(x == y for x, y in used) / len(used) if used else 1.0


def by_hand(docs):
    rows = sorted(((d, t or "") for d, t in docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for i, (d, t) in enumerate(rows):
        nxt, c = rows[(i + 1) % len(rows)][1], len(t) // 4
        changed = t[: len(t) - c] + nxt[:c]
        a, b = print_by_hand(t), print_by_hand(changed)
        out.append((d, len(t), hashlib.sha256(changed.encode()).hexdigest(), a, b, near(a, b), near(a, print_by_hand(nxt))))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, text string, n_chars long, block string, info string, key string"


@pytest.mark.parametrize("block", [1, 4, 64])
def test_rows_equal_the_plain_version(spark, monkeypatch, block):
    monkeypatch.setattr(O, "BLOCK_DOCS", block)
    rng = random.Random(block)
    words = "a b c dé 日本語 x\x00y 😀 the of and".split() + [f"w{k}" for k in range(30)]
    say = lambda n: rng.choice([" ", "\n", "  \t", "  "]).join(rng.choice(words[: rng.choice([3, 40])]) for _ in range(n))
    docs = [(rng.randrange(-50, 1000) * 10**rng.randrange(6), say(rng.choice([0, 1, 2, 3, 4, 40, 300]))) for _ in range(90)]
    docs += [(5, "same text here " * 9)] * 3 + [(d, "hot copy of one text, many times over") for d in range(2000, 2040)] + [(None, "no id"), (None, None), (7, None), (-(1 << 62), "least"), (1 << 62, "w " * 30_000), (8, "z" * 200_000)]
    frame = spark.createDataFrame([(*d, 1, "b", "i", "k") for d in docs], SCHEMA).repartition(5)
    assert sorted(map(tuple, O.compared(frame).collect()), key=repr) == by_hand(docs)


def test_single_and_empty_tables(spark):
    assert O.compared(spark.createDataFrame([], SCHEMA)).count() == 0
    for docs in ([(3, "one two three four five six")], [(None, None)], [(1, ""), (2, "a b c d e f g h")]):
        frame = spark.createDataFrame([(*d, 1, "b", "i", "k") for d in docs], SCHEMA)
        assert sorted(map(tuple, O.compared(frame).collect()), key=repr) == by_hand(docs)


def test_likeness_follows_edits_and_order(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(3000)}" for _ in range(2000)]
    few, many = list(words), list(words)
    for k in range(0, 2000, 200):
        few[k] = "edited"
    for k in range(0, 2000, 20):
        many[k] = "edited"
    turned = words[1000:] + words[:1000]  # nearly the same k-mers, in another order
    texts = [(0, words), (1, few), (2, many), (3, turned), (4, words)]
    rows = spark.createDataFrame([(k, " ".join(w)) for k, w in texts], "k long, text string").repartition(2, "k")
    got = {r.k: r.fingerprint for r in O.fingerprints(rows, ["k"], F.struct("k")).select("k", "fingerprint").collect()}
    assert got[0] == got[4]
    assert 0.7 < near(got[0], got[1]) < 1 and 0.2 < near(got[0], got[2]) < near(got[0], got[1])
    assert near(got[0], got[3]) < 0.75  # a set of k-mers would give about 0.99


def test_one_shuffle_of_texts_and_no_python(spark, small):
    plan = O.op11_document_fingerprints(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert plan.count("Exchange") - plan.count("BroadcastExchange") - plan.count("ENSURE_REQUIREMENTS") == 1 and plan.count("ENSURE_REQUIREMENTS") <= 1
