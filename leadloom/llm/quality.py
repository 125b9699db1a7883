"""Quality rules by a ledger of failure bits.

Every rule is measured once per document; the ledger keeps the measurements and one bit per failed rule. A policy is a
version with a mask: a document is rejected if ``fail_bits & mask`` is not zero. Changing a policy, or asking what a rule
alone rejects, reads the ledger and never the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import table

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long"

#: Bit order of the ledger: name and failing condition over the measurements. Append only, so that old ledgers stay valid.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 30 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 60 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("upper_case", "2 * n_upper > n_letters"),
)
BITS = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = BITS["few_words"] | BITS["repeated_windows"]

#: Versioned policies: the mask of the rules that reject.
POLICIES = {"base": BASE, "v1": (1 << len(RULES)) - 1}

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[ord("A") : ord("Z") + 1] = True
LETTER = UPPER.copy()
LETTER[ord("a") : ord("z") + 1] = True
RUN = 8


def _repeats(w: W.Words) -> np.ndarray:
    """Words per text in runs of 8 words that the text holds twice or more."""
    n, counts = len(w.starts), np.diff(w.first)
    if n < RUN:
        return np.zeros(len(counts), np.int64)
    runs = W.windows(w.hashes(), RUN)
    starts = np.flatnonzero(W.inside_text(w.first, RUN, n))
    if not len(starts):
        return np.zeros(len(counts), np.int64)
    text = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)[starts]
    key = W.mix(runs[starts] ^ W.mix(text + np.uint64(1)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = W.covered(starts[twice], RUN, n)
    total = np.concatenate([[0], np.cumsum(inside)])
    return np.diff(total[w.first])


def _measure(texts: list[bytes]) -> list[np.ndarray]:
    w = W.Words(texts)
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    return [
        np.diff(w.first),
        w.sums(w.inside & ((w.buf & 0xC0) != 0x80)),
        w.sums(SYMBOLS[w.buf]),
        np.array([len(x) - len(set(x)) for x in lines], np.int64),
        _repeats(w),
        np.array([len(x) for x in lines], np.int64),
        w.sums(UPPER[w.buf]),
        w.sums(LETTER[w.buf]),
    ]


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements; one pass over the texts in Arrow batches, no shuffle. Null text counts as empty."""
    names = [x.split()[0] for x in MEASURES.split(", ")]
    rest = [c for c in docs.columns if c not in names]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(rest).schema) + f", {MEASURES}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = W.texts_of(batch.column(rest.index(text)))
            parts = [_measure(texts[a:b]) for a, b in W.pieces(texts)] or [_measure([])]
            columns = [pa.array(np.concatenate([p[k] for p in parts]).astype(np.int64)) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*rest, *names])

    return docs.select(rest).mapInArrow(run, schema)


def fail_bits() -> Column:
    """The ledger's bits from the measurements, each rule evaluated once."""
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, rule) in enumerate(RULES)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out.cast("long")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements and ``fail_bits``.

    Null and empty texts fail ``few_words``; repeated rows are measured each; an empty table gives an empty ledger; columns
    of ``docs`` that clash with a measurement are replaced by it; other columns pass through.
    """
    return measured(docs, text).withColumn("fail_bits", fail_bits())


def kept_by(version: str) -> Column:
    """True where the policy of this version keeps the document."""
    return F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version])) == 0


def ablations(book: DataFrame, policies: dict[str, int] = POLICIES) -> DataFrame:
    """Per policy and rule: documents failing the rule, and those that only this rule rejects.

    The ledger is first counted by distinct bit pattern (at most 2 ** rules rows, pre-aggregated in each task); all policies
    are then applied to the patterns.
    """
    spark = book.sparkSession
    patterns = book.groupBy("fail_bits").count()
    grid = [(v, name, mask, bit) for v, mask in policies.items() for name, bit in BITS.items() if mask & bit]
    rules = F.broadcast(spark.createDataFrame(grid, "policy string, rule string, mask long, bit long"))
    hit = patterns.join(rules, (F.col("fail_bits").bitwiseAND(F.col("bit")) != 0), "right")
    n = F.coalesce(F.col("count"), F.lit(0))
    alone = F.col("fail_bits").bitwiseAND(F.col("mask")) == F.col("bit")
    return hit.groupBy("policy", "rule").agg(F.sum(n).alias("n_failed"), F.sum(F.when(alone, n).otherwise(0)).alias("n_only")).orderBy("policy", "rule")


def filtered(docs: DataFrame, version: str = "v1", text: str = "text") -> DataFrame:
    """The documents that the policy keeps, with the columns of ``docs``."""
    return ledger(docs, text).where(kept_by(version)).select(docs.columns)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("fail_bits").bitwiseAND(F.lit(BASE)) != 0).alias("base_failed"), kept_by("v1").alias("kept"), "fail_bits",
    )
