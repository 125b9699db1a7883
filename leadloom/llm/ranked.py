"""Ranked lexical search: the best documents for each of a set of texts, by buckets of impact vectors of similar length.

A document is a sparse vector over the terms of the query texts: for each of them its impact, an integer. A score is the sum of
the impacts of a query's terms, that is the inner product with a vector of zeros and ones. Vectors are put in descending order of
length over all partitions, so a stretch of rows is a bucket of vectors of about one length. A query with ``k`` terms scores at
most ``sqrt(k)`` times a vector's length (Cauchy-Schwarz), which prunes whole buckets against the score that the query's tenth
document has so far. Inside a bucket the coordinates of the query's heaviest terms are added up and the rest is bounded, by the
length that is left and by the bucket's largest coordinates; what may still reach the threshold is scored exactly in integers.

The longest buckets are searched first and give each query its threshold for the others, which are then searched all at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

TOP = 10
#: Bytes that are in terms: digits, letters and all beyond ASCII; A-Z become lower case, the others spaces.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
STRETCH = 1 << 20
#: Characters of query texts that are searched for in one go (more are searched in blocks), so what tasks are sent is bounded.
BLOCK_CHARS = 1 << 22
#: Vectors to search for thresholds, at least, and the most in a bucket, whose shortest is at least this share of the longest.
LONGEST, BUCKET, RATIO = 4096, 2048, 0.9
#: Share of a query's terms, the heaviest, whose coordinates are added up before a document is pruned.
FOCUS = 0.6
SLACK = 1 + 1e-9
NO_ID = np.iinfo(np.int64).min
RESULT = "item int, doc_id long, score long"


def term_counts(text: bytes) -> tuple[Counter, int]:
    """Terms of a text with their occurrences, and how many there are; read a stretch at a time."""
    counts, a, n = Counter(), 0, 0
    while a < len(text):
        b = a + STRETCH
        while b < len(text) and FOLD[text[b]] != 32:
            b += 1
        some = text[a:b].translate(FOLD).split()
        counts.update(some)
        n += len(some)
        a = b
    return counts, n


@dataclass
class Queries:
    """A block of query texts: their ids, their terms as numbers, and the numbers of all terms."""

    ids: list
    terms: list[np.ndarray]
    known: dict[bytes, int]


def blocks_of(items: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[Queries]:
    """The query texts in blocks of about ``block_chars`` characters, dealt by hash; equal rows count once."""
    items = items.select(F.col("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // block_chars)
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        known: dict[bytes, int] = {}
        terms = [np.array([known.setdefault(t, len(known)) for t in term_counts(r.text.encode())[0]], np.int64) for r in rows]
        if known:
            yield Queries([r.item_id for r in rows], terms, known)


def vectors(docs: DataFrame, known: dict[bytes, int], text: str = "text") -> DataFrame:
    """``(doc_id, n, terms, tfs)`` of the documents with a term of any kind: all their terms counted, the known ones by number."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = sent.value
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                ids, ns, terms, tfs = [], [], [], []
                for doc_id, t in zip(part.column(0).to_pylist(), part.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                    counts, n = term_counts(t or b"")
                    if n:
                        found = sorted((numbers[w], counts[w]) for w in counts.keys() & numbers.keys())
                        ids.append(doc_id)
                        ns.append(n)
                        terms.append([x for x, _ in found])
                        tfs.append([x for _, x in found])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def weights_of(rows: DataFrame, n_docs: int, n_terms: int) -> np.ndarray:
    """Weight per term, from the documents that hold it; a term that none holds weighs as much as it may."""
    held = np.zeros(n_terms, np.int64)
    for term, df in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():
        held[term] = df
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * held + 1))).astype(np.int64)


def impacts_of(terms: np.ndarray, tfs: np.ndarray, m: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return weights[terms] * (1_000_000_000 * tfs // (1000 * tfs + 8 * m))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """``doc_id, m, first, terms, tfs`` of a batch; row i has ``terms[first[i]:first[i + 1]]``."""
    ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
    lists = [batch.column(k) for k in ("terms", "tfs")]
    sizes = lists[0].value_lengths().to_numpy(zero_copy_only=False)
    terms, tfs = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
    return ids, batch.column("m").to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), terms, tfs


def by_length(rows: DataFrame, n_docs: int, all_terms: int, weights: np.ndarray) -> DataFrame:
    """The vectors with their length (``norm``), in descending order of it over all partitions; equal lengths may be split."""
    m = F.lit(100 - 90).cast("long") + F.expr(f"(90 * n * {n_docs}L) div {all_terms}L")
    names = ["doc_id", "m", "terms", "tfs"]
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, m, first, terms, tfs = _flat(batch)
            x = impacts_of(terms, tfs, np.repeat(m, np.diff(first)), sent.value).astype(float)
            squares = np.add.reduceat(x * x, first[:-1]) if len(first) > 1 else np.zeros(0)  # no row is without a term
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.sqrt(squares))], [*names, "norm"])

    full = rows.where(F.size("terms") > 0).select("doc_id", m.alias("m"), "terms", "tfs").mapInArrow(run, "doc_id long, m long, terms array<int>, tfs array<long>, norm double")
    full = full.where("norm > 0").withColumn("salt", F.xxhash64("doc_id", "m"))
    return saved(full.repartitionByRange(F.desc("norm"), "salt").sortWithinPartitions(F.desc("norm")).drop("salt"), "impact-vectors")


class Bucket:
    """Vectors of about one length: rows, and their coordinates by term."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, terms: np.ndarray, impacts: np.ndarray, norms: np.ndarray, n_terms: int):
        self.ids, self.first, self.terms, self.impacts = ids, first, terms, impacts
        self.squares, self.longest = (norms * SLACK) ** 2, norms.max() * SLACK
        order = np.argsort(terms, kind="stable")
        self.rows, self.values = np.repeat(np.arange(len(ids)), np.diff(first))[order], impacts[order].astype(float)
        self.at = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.most = np.zeros(n_terms)
        held = np.flatnonzero(np.diff(self.at))
        self.most[held] = np.maximum.reduceat(self.values, self.at[held]) if len(held) else 0

    def may_reach(self, query: np.ndarray, least: int) -> np.ndarray:
        """Rows that the bounds leave for a query (terms by descending weight) whose score must be ``least`` or more."""
        n_focus = max(1, int(FOCUS * len(query)))
        focus, rest = query[:n_focus], query[n_focus:]
        at = np.concatenate([np.arange(self.at[t], self.at[t + 1]) for t in focus])
        rows, values = self.rows[at], self.values[at]
        so_far = np.bincount(rows, values, len(self.ids))
        left = np.maximum(self.squares - np.bincount(rows, values * values, len(self.ids)), 0)
        bound = so_far + np.minimum(np.sqrt(len(rest) * left), self.most[rest].sum())
        return np.flatnonzero(bound * SLACK >= max(least, 1))

    def scores(self, rows: np.ndarray, query: np.ndarray, n_terms: int) -> np.ndarray:
        wanted = np.zeros(n_terms, np.int64)
        wanted[query] = 1
        sizes = self.first[rows + 1] - self.first[rows]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.first[rows] - (ends - sizes), sizes)
        return np.add.reduceat(self.impacts[at] * wanted[self.terms[at]], ends - sizes)


def _best(scores: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    keep = np.lexsort((ids, -scores))[:top]
    return scores[keep], ids[keep]


def searched(rows: DataFrame, queries: Queries, weights: np.ndarray, least: np.ndarray, top: int) -> DataFrame:
    """For each query the best ``top`` rows of every partition, of those that score ``least`` or more."""
    heavy_first = [q[np.argsort(-weights[q], kind="stable")] for q in queries.terms]
    sent = rows.sparkSession.sparkContext.broadcast((heavy_first, weights, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms_of, weights, least = sent.value
        reach = [len(q) ** 0.5 for q in terms_of]
        floor, best = least.copy(), [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(terms_of)
        for batch in batches:
            ids, m, first, terms, tfs = _flat(batch)
            norms = batch.column("norm").to_numpy(zero_copy_only=False)
            impacts = impacts_of(terms, tfs, np.repeat(m, np.diff(first)), weights)
            a = 0
            while a < len(ids):
                b = a + 1 + int(np.argmax(np.append(norms[a + 1 : a + BUCKET] < RATIO * norms[a], True)))
                todo = [k for k, q in enumerate(terms_of) if len(q) and reach[k] * norms[a] * SLACK >= max(floor[k], 1)]
                if todo:
                    cut = slice(first[a], first[b])
                    bucket = Bucket(ids[a:b], first[a : b + 1] - first[a], terms[cut], impacts[cut], norms[a:b], len(weights))
                for k in todo:
                    some = bucket.may_reach(terms_of[k], floor[k])
                    if len(some):
                        scores = bucket.scores(some, terms_of[k], len(weights))
                        good = scores >= max(floor[k], 1)
                        best[k] = _best(np.concatenate([best[k][0], scores[good]]), np.concatenate([best[k][1], bucket.ids[some][good]]), top)
                        if len(best[k][0]) == top:
                            floor[k] = max(floor[k], best[k][0][-1])
                a = b
        sizes = [len(s) for s, _ in best]
        found = np.concatenate([i for _, i in best])
        columns = [pa.array(np.repeat(np.arange(len(best)), sizes), pa.int32()), pa.array(found, pa.int64(), mask=found == NO_ID), pa.array(np.concatenate([s for s, _ in best]), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    return rows.mapInArrow(run, RESULT)


def ranked(found: DataFrame, top: int) -> DataFrame:
    """``rank`` per item; rows of one item are thinned in sub-keys first, however many tasks have sent some."""
    best = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id"))
    thin = found.withColumn("sub", F.pmod(F.xxhash64("doc_id", "score"), F.lit(64))).withColumn("rank", best("item", "sub")).where(F.col("rank") <= top)
    return thin.drop("sub", "rank").withColumn("rank", best("item")).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: for each text of ``items`` the ``top`` documents with the highest scores above 0.

    Null and empty texts have no terms: such documents are not counted and such items have no rows. Equal scores rank by ascending
    doc_id, null first. Repeated rows of documents count and rank each; equal items count once, items that share an id but not a
    text are ranked each. Empty tables give no rows; other columns do not matter. Exact for any data: bounds only skip rows that
    cannot be among the best.
    """
    spark, out = docs.sparkSession, None
    for queries in blocks_of(items, block_chars):
        rows = saved(vectors(docs, queries.known, text), "term-vectors")
        n_docs, all_terms = rows.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        weights = weights_of(rows, n_docs, len(queries.known))
        ordered = by_length(rows, n_docs, all_terms, weights)
        step = F.floor(F.log(1 / RATIO, "norm"))
        lengths = sorted(ordered.groupBy(step.alias("s")).count().collect(), reverse=True)
        total = np.cumsum([r[1] for r in lengths])
        if not len(total):
            continue
        cut = float((1 / RATIO) ** lengths[int(np.argmax(total >= min(LONGEST, total[-1])))][0])
        zero = np.zeros(len(queries.ids), np.int64)
        longest = saved(ranked(searched(ordered.where(F.col("norm") >= cut), queries, weights, zero, top), top), "ranked-longest")
        least = zero.copy()
        for item, score in longest.where(F.col("rank") == top).select("item", "score").collect():
            least[item] = score
        norm = min(max(s, 1) / max(len(q), 1) ** 0.5 for s, q in zip(least, queries.terms, strict=True)) / SLACK
        rest = searched(ordered.where((F.col("norm") < cut) & (F.col("norm") >= float(norm))), queries, weights, least, top)
        names = spark.createDataFrame(list(enumerate(queries.ids)), f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        best = ranked(longest.select("item", "doc_id", "score").union(rest), top).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = best if out is None else out.union(best)
    return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long") if out is None else out


def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_12 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWER}, '{TERM}') AS ts FROM documents),
q AS (SELECT iid, item_id, unnest(ts) AS term FROM (SELECT row_number() OVER () AS iid, item_id, list_distinct(regexp_extract_all({LOWER}, '{TERM}')) AS ts FROM (SELECT DISTINCT item_id, text FROM benchmark))),
c AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS all_terms FROM d WHERE len(ts) > 0),
t AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY term), c),
m AS (SELECT rid, doc_id, 100 - 90 + (90 * len(ts) * n_docs) // all_terms AS m FROM d, c),
s AS (SELECT iid, item_id, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN t USING (term) JOIN m USING (rid) GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS FIRST) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= {TOP}
"""
