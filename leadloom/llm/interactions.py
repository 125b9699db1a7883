"""What each of several filters removes in every order of applying them, by decision diagrams of failure masks.

Every document is measured once and gets a mask with one bit per failed filter. Masks are counted per part, so a part is at
most ``2 ** filters`` rows however many documents it has. From these counts a diagram is built per part: one level per filter,
a low edge for documents that pass and a high edge for those that fail, equal sub-diagrams shared, every node weighted with the
documents, good and toxic ones below it. Neighbouring levels are swapped to go from one order to the next. In any order the
path along the low edges is the sequence of survivors, and the high edges that leave it are what each step removes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import saved, table

#: Filters by letter; bit k of a mask is filter k. E needs all documents and is judged apart (``repeats``).
FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
MIN_WORDS, DISTINCT_PCT, UPPER_PCT = 50, 65, 5
REPEAT = 1 << FILTERS.index("E")

UPPER = bytes(range(ord("A"), ord("Z") + 1))
MARKS = b"#$%&*|"
CONTINUED = bytes(range(0x80, 0xC0))
STRETCH = 1 << 20

Weight = tuple[int, int, int]
Node = tuple  # (low, high, weight); a leaf is (None, None, weight)
NOTHING: Weight = (0, 0, 0)


# ---- masks


def _words(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, a stretch at a time, so that a very long text is never a list of all its words."""
    a = 0
    while a < len(text):
        b = a + STRETCH
        while b < len(text) and not W.SPACES[text[b]]:
            b += 1
        yield text[a:b].split()
        a = b


def mask_of(text: bytes) -> int:
    """Failure bits A to D of one text."""
    n, distinct = 0, set()
    for some in _words(text):
        n += len(some)
        distinct.update(some)
    upper = len(text) - len(text.translate(None, UPPER))
    marks = len(text) - len(text.translate(None, MARKS))
    points = len(text.translate(None, CONTINUED))
    return (n < MIN_WORDS) | (100 * len(distinct) < DISTINCT_PCT * n) << 1 | (100 * upper > UPPER_PCT * points) << 2 | (marks > 0) << 3


def masked(docs: DataFrame, part: str = "source", text: str = "text") -> DataFrame:
    """``(doc_id, part, digest, mask)`` per row: bits A to D and the SHA-256 of the text; one pass, no shuffle. Null text or part: empty."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = "doc_id long, part string, digest binary, mask int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = pa.array([mask_of(t) for t in W.texts_of(batch.column(3))], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], masks], ["doc_id", "part", "digest", "mask"])

    return narrow.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), "text").mapInArrow(run, schema)


def repeats(rows: DataFrame) -> DataFrame:
    """``rows`` counted by all their columns (``n``), bit E set where the same text has a smaller doc_id in the table.

    The smallest id per digest is a grouped minimum; it meets the rows on digest and id together, so the copies of a text,
    however many, lie under as many keys. Rows without a doc_id pass, and none is a repeat of them.
    """
    rows = saved(rows.groupBy(rows.columns).agg(F.count("*").alias("n")), "masked")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    failed = F.when(F.col("doc_id").isNotNull() & F.col("is_first").isNull(), F.lit(REPEAT)).otherwise(F.lit(0))
    return rows.join(first, ["digest", "doc_id"], "left").withColumn("mask", F.col("mask").bitwiseOR(failed)).drop("is_first")


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "source", text: str = "text") -> DataFrame:
    """``(part, mask, n, n_good, n_toxic)``: at most 32 rows per part. A document is good (toxic) if any of its labels says so."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    rows = repeats(masked(docs, part, text)).join(known, "doc_id", "left")
    of = lambda flag: F.sum(F.col("n") * F.coalesce(F.col(flag), F.lit(0)))
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good").alias("n_good"), of("toxic").alias("n_toxic"))


# ---- diagrams


class Diagram:
    """A shared, count-weighted decision diagram over the filters, its levels in the order ``order``.

    Nodes are kept once in a table per level structure; an empty branch is ``None`` at any level.
    """

    def __init__(self, counts: list[Weight]):
        self.known: dict[tuple, Node] = {}
        self.order = list(range(len(counts).bit_length() - 1))
        self.root = self._built(counts, 0, 0)

    def _node(self, low: Node | None, high: Node | None) -> Node | None:
        if low is None and high is None:
            return None
        key = (id(low), id(high))
        if key not in self.known:
            a, b = (x[2] if x else NOTHING for x in (low, high))
            self.known[key] = (low, high, (a[0] + b[0], a[1] + b[1], a[2] + b[2]))
        return self.known[key]

    def _leaf(self, weight: Weight) -> Node | None:
        return self.known.setdefault(("leaf", weight), (None, None, weight)) if any(weight) else None

    def _built(self, counts: list[Weight], level: int, mask: int) -> Node | None:
        if level == len(self.order):
            return self._leaf(counts[mask])
        return self._node(self._built(counts, level + 1, mask), self._built(counts, level + 1, mask | 1 << self.order[level]))

    def swap(self, level: int) -> None:
        """Exchange the filters at ``level`` and ``level + 1``: below each node of that level the two middle branches change places."""
        done: dict[int, Node | None] = {}

        def at(node: Node | None, depth: int) -> Node | None:
            if node is None:
                return None
            if id(node) not in done:
                low, high = node[0], node[1]
                if depth < level:
                    done[id(node)] = self._node(at(low, depth + 1), at(high, depth + 1))
                else:
                    (a, b), (c, d) = (x[:2] if x else (None, None) for x in (low, high))
                    done[id(node)] = self._node(self._node(a, c), self._node(b, d))
            return done[id(node)]

        self.root = at(self.root, 0)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> list[tuple[int, Weight, Weight]]:
        """Along the path that passes every filter: filter, what is kept after it, what it removes."""
        out, node = [], self.root
        for filter_ in self.order:
            low, high = node[:2] if node else (None, None)
            out.append((filter_, low[2] if low else NOTHING, high[2] if high else NOTHING))
            node = low
        return out


def swaps(n: int) -> list[int]:
    """Levels to swap, one after the other, so that all orders of n filters come up once: each order follows from the last by one swap."""
    order, ahead, out = list(range(n)), [-1] * n, []
    while True:
        movable = [x for k, x in enumerate(order) if 0 <= k + ahead[x] < n and order[k + ahead[x]] < x]
        if not movable:
            return out
        x = max(movable)
        k = order.index(x)
        j = k + ahead[x]
        order[k], order[j] = order[j], order[k]
        out.append(min(j, k))
        for y in range(x + 1, n):
            ahead[y] = -ahead[y]


def audited(counts: list[Weight]) -> list[tuple]:
    """Rows ``(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)`` for the counts of each mask."""
    diagram, paths = Diagram(counts), []
    for level in [None, *swaps(len(FILTERS))]:
        if level is not None:
            diagram.swap(level)
        paths.append(("".join(FILTERS[f] for f in diagram.order), diagram.steps()))
    failing, alone, shapley = ([0] * len(FILTERS) for _ in range(3))
    for _, path in paths:
        for k, (f, _, gone) in enumerate(path):
            shapley[f] += gone[0]
            if k == 0:
                failing[f] = gone[0]  # first of all, a filter removes whatever fails it
            if k == len(path) - 1:
                alone[f] = gone[0]  # last of all, only what fails nothing else
    return [(order, k + 1, kept[0], gone[0], failing[f] - gone[0], alone[f], gone[1], gone[2], shapley[f]) for order, path in paths for k, (f, kept, gone) in enumerate(path)]


AUDIT = "filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", text: str = "text") -> DataFrame:
    """One row per part, order of the filters and step.

    Null text and null part are empty; a text without words fails A only (0 is not under 65 percent of 0); repeated rows count
    each, with one doc_id they are not repeats of each other; rows without a doc_id never fail E and have no label; ``labels``
    may repeat or lack documents; an empty table gives no rows; other columns do not matter. What reaches a task at once is the
    32 counts of a part, of some parts.
    """
    counts = saved(mask_counts(docs, labels, part, text), "mask-counts")
    schema = f"part string, {AUDIT}"
    names = [x.split()[0] for x in AUDIT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                weights = [NOTHING] * MASKS
                for c in cells:
                    weights[c["mask"]] = (c["n"], c["n_good"], c["n_toxic"])
                rows = audited(weights)
                yield pa.RecordBatch.from_pydict({"part": [name] * len(rows)} | dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)), schema=wanted)

    wanted = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((n, pa.int64()) for n in names[2:])])
    cells = F.collect_list(F.struct("mask", "n", "n_good", "n_toxic"))  # at most 32, one per mask
    return counts.groupBy("part").agg(cells.alias("cells")).mapInArrow(run, schema)


def op13_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return audit(docs, table(spark, sf_dir, "labels"))


ORDERS = ", ".join(f"('{''.join(p)}')" for p in permutations(FILTERS))
ORACLE_13 = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
f AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(ws) < {MIN_WORDS} AS "A", 100 * len(list_distinct(ws)) < {DISTINCT_PCT} * len(ws) AS "B",
  100 * len(regexp_extract_all(t, '[A-Z]')) > {UPPER_PCT} * length(t) AS "C", regexp_matches(t, '[#$%&*|]') AS "D", coalesce(d.doc_id > first, false) AS "E"
  FROM d JOIN f USING (t) LEFT JOIN l ON l.doc_id = d.doc_id),
c AS (SELECT part, CASE WHEN "A" THEN 'A' ELSE '' END || CASE WHEN "B" THEN 'B' ELSE '' END || CASE WHEN "C" THEN 'C' ELSE '' END || CASE WHEN "D" THEN 'D' ELSE '' END || CASE WHEN "E" THEN 'E' ELSE '' END AS fails,
  count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
o AS (SELECT col0 AS filter_order, unnest(range(1, 6)) AS step FROM (VALUES {ORDERS})),
s AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, n, good, toxic, fails, contains(fails, substr(filter_order, step, 1)) AS hit,
  len(list_filter(string_split(fails, ''), lambda x: x <> '' AND contains(substr(filter_order, 1, step - 1), x))) > 0 AS gone FROM c, o),
r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, letter, CAST(coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (NOT gone AND hit), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (gone AND hit), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fails = letter), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (NOT gone AND hit), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (NOT gone AND hit), 0) AS BIGINT) AS toxic_lost FROM s GROUP BY ALL)
SELECT * EXCLUDE (letter), CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r
"""
