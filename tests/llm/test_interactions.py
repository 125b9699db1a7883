"""Filter interaction audit against a plain count over all rows in every order."""

import random
import re
from itertools import permutations

from leadloom.llm import interactions as I

SCHEMA = "doc_id long, source string, text string, n_chars long, mask string, part string"


def by_hand(docs, labels):
    """Rows of the audit, counted row by row."""
    good, toxic = ({d for d, *x in labels if d is not None and x[k] == 1} for k in (0, 1))
    rows = []
    for d, source, text in docs:
        text = text or ""
        words = [w for w in re.split("[ \t-\r]+", text) if w]
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), "D": any(c in "#$%&*|" for c in text),
            "E": d is not None and any(e is not None and e < d and (t or "") == text for e, _, t in docs),
        }
        rows.append((source or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = [r for r in mine if f in r[1]]
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        total = {f: sum(v[1] for (p, o, s), v in out.items() if p == part and o[s - 1] == f) for f in "ABCDE"}
        for p, o, s in [k for k in out if k[0] == part]:
            out[p, o, s].append(total[o[s - 1]])
    return out


def test_swaps_reach_every_order_once():
    for n in (1, 2, 3, 5):
        order, seen = list(range(n)), [tuple(range(n))]
        for k in I.swaps(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            seen.append(tuple(order))
        assert sorted(seen) == sorted(permutations(range(n)))


def test_swapped_diagram_equals_one_built_in_that_order():
    rng = random.Random(3)
    counts = [(rng.randrange(4), rng.randrange(2), 0) if rng.random() < 0.5 else I.NOTHING for _ in range(I.MASKS)]
    d = I.Diagram(counts)
    assert d.root[2][0] == sum(c[0] for c in counts)
    for k in I.swaps(5):
        d.swap(k)
        turned = [I.NOTHING] * I.MASKS
        for mask, c in enumerate(counts):
            turned[sum(1 << level for level, f in enumerate(d.order) if mask >> f & 1)] = c
        assert [(d.order[f], *rest) for f, *rest in I.Diagram(turned).steps()] == d.steps()


def test_audit_equals_counts_by_hand(spark):
    rng = random.Random(1)
    texts = [None, "", " ", "\t\n", "a " * 60, "A" * 5 + "b" * 95, "A" * 6 + "b" * 94, "é#", "x y", " ".join(map(str, range(50))), " ".join(map(str, range(49))), "w " * 20 + " ".join(map(str, range(39))), "z" * 1_200_000, " ".join(map(str, range(200_000)))]
    ids = [None, None, 0, *range(1, 60), 7, 7, 8]
    docs = [(d, rng.choice([None, "", "hot", "hot", "hot", "b"]), rng.choice(texts)) for d in ids]
    docs += [(7, "hot", "same"), (7, "hot", "same"), (7, "b", "same"), (9, "b", "same"), (100, "only", "one")]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d in [None, *range(0, 50), 7, 7, 500]]
    want = by_hand(docs, labels)
    for parts in (1, 7):
        frame = spark.createDataFrame([(*d, 1, "m", "p") for d in docs], SCHEMA).repartition(parts)
        got = {(r.part, r.filter_order, r.step): list(r[3:]) for r in I.audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
        assert got == want


def test_audit_of_empty_tables(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert I.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(None, None, None, None, None, None)], SCHEMA)
    rows = I.audit(one, labels).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""}
    assert all((r.removed, r.redundant, r.unique_fails) == ((1, 0, 1) if r.filter_order[r.step - 1] == "A" else (0, 0, 0)) for r in rows)
