"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of every 20-word window, the 8-word run with the smallest hash. Consecutive windows with the same
anchor make a stretch, which is the anchor extended both ways as far as it rules; so each window lies in exactly one stretch
and equal windows always have equal anchors. Documents are joined on anchors, never pairwise:

* a stretch that repeats an earlier one whole is a repeat of it;
* where an anchor has different stretches (the ends of repeats), or a stretch has its anchor twice, the first is opened into
  its windows, and a window that begins earlier elsewhere is a repeat of that.

Each match is then extended both ways over the adjoining matches on its diagonal (same earlier document, same distance), which
gives the maximal repeats; all of them are at least a window long.

A hot stretch is thinned in each task before the shuffle: repeats that a task has met are known there, and of an anchor with
different stretches one row per batch travels under the anchor, which is enough to know that it is contested.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .common import saved, table

WINDOW = 20
ANCHOR = 8
#: Of a place: low bits are the word position in the text, high bits tell texts apart that share a doc_id.
TAG_SHIFT = 40
TAG_BITS = 23
NO_ID = -(1 << 63)
#: Hot stretches that a task keeps in mind; others meet after the shuffle.
MET = 1 << 17
U = np.uint64


def _tag(text: bytes) -> int:
    return (xxhash.xxh64_intdigest(text) & ((1 << TAG_BITS) - 1)) << TAG_SHIFT


def _least(h: np.ndarray, span: int) -> np.ndarray:
    """Smallest of every ``span`` neighbours, by doubling."""
    out, have = h, 1
    while have < span:
        step = min(have, span - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _stretches(texts: list[bytes], window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Of all texts: text number, word position, windows, anchor hash, body hash of each stretch, and if it holds its anchor twice."""
    w = W.Words(texts)
    h = w.hashes()
    n = len(h) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),) * 2 + (np.zeros(0, bool),)
    span, seeds = window - anchor + 1, W.windows(h, anchor)
    least = _least(seeds, span)
    valid = W.inside_text(w.first, window, len(h))
    new = valid.copy()
    new[1:] &= ~(valid[:-1] & (least[1:] == least[:-1]))
    start = np.flatnonzero(new)
    stop = np.append(start[1:], n)
    gaps = np.flatnonzero(~valid)
    if len(gaps) and len(start):
        at = np.searchsorted(gaps, start)
        stop = np.minimum(stop, np.where(at < len(gaps), gaps[np.minimum(at, len(gaps) - 1)], n))
    size = stop - start
    power, inverse = (W._powers(b, len(h) + 1) for b in (W.BASES[1], pow(W.BASES[1], -1, 1 << 64)))
    total = np.zeros(len(h) + 1, U)
    np.cumsum(h * power[:-1], out=total[1:])
    body = W.mix((total[stop + window - 1] - total[start]) * inverse[start])
    text = np.searchsorted(w.first, start, side="right") - 1
    seen = size + span - 1
    upto = np.cumsum(seen)
    at = np.arange(upto[-1] if len(upto) else 0) + np.repeat(start - (upto - seen), seen)
    hits = np.append(0, np.cumsum(seeds[at] == np.repeat(least[start], seen)))
    twice = hits[upto] - hits[upto - seen] > 1
    return text, start - w.first[text], size, least[start], body, twice


def _thin(rows: dict[str, np.ndarray], met: dict[int, tuple[int, int]]) -> dict[str, np.ndarray]:
    """Mark what a task knows already, and set routes: ``dup`` repeats ``first_id, first_place``, ``contested`` has a rival here.

    ``met`` holds the earliest place of stretches that the task has seen twice; it has a bounded number of them, and what it
    lacks is found after the shuffle.
    """
    key = W.mix(rows["anchor"] ^ W.mix(rows["body"] + rows["n"].astype(U)))
    order = np.lexsort((rows["place"], rows["id"], key))
    rows = {k: v[order] for k, v in rows.items()}
    key = key[order]
    head = np.append(True, key[1:] != key[:-1])[: len(key)]
    lead = np.flatnonzero(head)[np.cumsum(head) - 1]
    same = (rows["id"] == rows["id"][lead]) & (rows["place"] == rows["place"][lead])
    rows |= {"first_id": rows["id"][lead], "first_place": rows["place"][lead]}
    keep = head | ~same
    rows = {k: v[keep] for k, v in rows.items()}
    key, dup = key[keep], ~head[keep]
    hot = key[dup]
    known = np.isin(key, hot) | np.isin(key, np.fromiter(met, U, len(met)))
    hot = set(hot.tolist())
    for i in np.flatnonzero(~dup & known).tolist():
        k, at = int(key[i]), (int(rows["id"][i]), int(rows["place"][i]))
        if (before := met.get(k)) is not None and before < at:
            dup[i], rows["first_id"][i], rows["first_place"][i] = True, *before
        elif before is not None or (k in hot and len(met) < MET):
            met[k] = at
    firsts = np.flatnonzero(~dup)
    firsts = firsts[np.lexsort((rows["body"][firsts], rows["anchor"][firsts]))]
    a = rows["anchor"][firsts]
    before = np.append(False, a[1:] == a[:-1])[: len(a)]
    after = np.append(a[1:] == a[:-1], False)[: len(a)]
    contested = np.zeros(len(key), bool)
    contested[firsts] = before | after | rows["twice"][firsts]
    route = rows["anchor"].copy()
    later = firsts[before]
    route[later] = key[later]
    route[dup] = W.mix(rows["place"][dup].astype(U) ^ W.mix(rows["id"][dup].astype(U)))
    return rows | {"dup": dup, "contested": contested, "route": route}


STRETCH = "route long, anchor long, body long, id long, place long, n long, first_id long, first_place long, dup boolean, contested boolean"


def stretches(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Stretches of ``docs(id, text)``, thinned within each Arrow batch."""
    names = [x.split()[0] for x in STRETCH.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, tuple[int, int]] = {}
        for batch in batches:
            texts, ids = W.texts_of(batch.column(1)), batch.column(0).to_numpy()
            tags = np.array([_tag(t) for t in texts], np.int64)
            parts = []
            for a, b in W.pieces(texts):
                text, place, n, seed, body, twice = _stretches(texts[a:b], window, anchor)
                parts.append((ids[a:b][text], tags[a:b][text] | place, n, seed, body, twice))
            if not parts:
                continue
            cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
            rows = _thin(dict(zip(("id", "place", "n", "anchor", "body", "twice"), cols, strict=True)), met)
            out = {k: v.view(np.int64) if v.dtype == U else v for k, v in rows.items()}
            yield pa.RecordBatch.from_arrays([pa.array(out[k]) for k in names], names)

    return docs.mapInArrow(run, STRETCH)


def judged(rows: DataFrame) -> DataFrame:
    """``(id, place, n, ask, first_id, first_place)``: stretches that repeat an earlier one (ask false), and first ones with a rival (ask true).

    A place is compared with the first place that has its stretch, never counted, so a row that comes twice is not its own repeat.
    """
    same = Window.partitionBy("route", "anchor", "body", "n")
    rivals = Window.partitionBy("route", "anchor")
    first = F.min(F.struct("first_id", "first_place")).over(same)
    rival = (F.min("body").over(rivals) != F.max("body").over(rivals)) | (F.min("n").over(rivals) != F.max("n").over(rivals)) | F.max("contested").over(rivals)
    out = rows.repartition("route").withColumn("first", first).withColumn("rival", rival)
    repeat = F.struct(F.col("id").alias("first_id"), F.col("place").alias("first_place")) != F.col("first")
    return out.where(repeat | F.col("rival")).select("id", "place", "n", (~repeat).alias("ask"), "first.first_id", "first.first_place")


def opened(asked: DataFrame, window: int) -> DataFrame:
    """Windows of ``asked(id, text, marks)`` with two hashes: ``(h1, h2, id, place)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, text, marks in zip(batch.column(0).to_pylist(), W.texts_of(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                tag = _tag(text)
                at = [np.arange(m["place"] - tag, m["place"] - tag + m["n"]) for m in marks if m["ask"] and m["place"] >> TAG_SHIFT == tag >> TAG_SHIFT]
                if not at:
                    continue
                at = np.unique(np.concatenate(at))
                h = W.Words([text]).hashes()
                h1, h2 = (W.windows(h, window, b)[at].view(np.int64) for b in W.BASES)
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(np.full(len(at), id_, np.int64)), pa.array(at + tag)], ["h1", "h2", "id", "place"])

    return asked.select("id", "text", "marks").mapInArrow(run, "h1 long, h2 long, id long, place long")


def repeated(docs: DataFrame, text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``docs(id, text)`` rows with ``marks`` and ``late``: the repeated stretches and single windows of each, and what they repeat."""
    body = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).alias("text"))
    mark = F.struct("place", "n", "ask", "first_id", "first_place")
    marks = saved(judged(stretches(body, window, anchor)).distinct().groupBy("id").agg(F.collect_list(mark).alias("marks")), "repeats")
    asked = body.join(marks.where(F.exists("marks", lambda m: m["ask"])), "id")
    at = saved(opened(asked, window), "repeat-windows")
    first = at.groupBy("h1", "h2").agg(F.min(F.struct("id", "place")).alias("first"), F.count("*").alias("m")).where("m > 1").select("h1", "h2", "first")
    first = saved(first, "repeat-firsts")  # with both sides read from files, a hot window's rows can be split in the join
    late = at.join(first, ["h1", "h2"]).where(F.struct("id", "place") != F.col("first"))
    late = late.groupBy("id").agg(F.collect_set(F.struct("place", F.col("first.id").alias("first_id"), F.col("first.place").alias("first_place"))).alias("late"))
    return body.join(marks, "id", "left").join(late, "id", "left")


def maximal(text: np.ndarray, start: np.ndarray, n: np.ndarray, id_: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Matches of ``n`` windows extended both ways: those of a text that adjoin on one diagonal become one repeat.

    A match begins at ``start`` and at ``first`` in document ``id_``. Gives text, start, words, id and first of each repeat, by text and start.
    """
    order = np.lexsort((start, start - first, id_, text))
    text, start, n, id_, first = (x[order] for x in (text, start, n, id_, first))
    diagonal = start - first
    other = np.append(True, (text[1:] != text[:-1]) | (id_[1:] != id_[:-1]) | (diagonal[1:] != diagonal[:-1]))[: len(text)]
    stop = start + n
    lift = np.cumsum(other) * (int(stop.max(initial=0)) + 1)
    reach = np.maximum.accumulate(stop + lift) - lift  # the furthest end so far on the same diagonal
    new = np.flatnonzero(other | np.append(True, start[1:] > reach[:-1])[: len(text)])
    words = reach[np.append(new[1:], len(text)) - 1] - start[new] + window - 1 if len(new) else start[new]
    again = np.lexsort((start[new], text[new]))
    return tuple(x[again] for x in (text[new], start[new], words, id_[new], first[new]))


def _spans(column: pa.Array, names: tuple[str, ...]) -> list[np.ndarray]:
    """Row numbers and the named fields of a column of lists of structs; null lists are empty."""
    rows = np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    flat = column.flatten()
    return [rows, *(flat.field(flat.type.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names)]


REPEAT = ("start", "n_words", "first_doc_id", "first_start")
KEPT = f"doc_id long, n_words long, n_removed long, kept string, repeats array<struct<{', '.join(f'{c}: long' for c in REPEAT)}>>"


def without_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept, repeats)`` per row of ``docs``; kept: the words left, joined by one space.

    A word goes if a window over it holds words that also begin earlier: in a smaller doc_id, or earlier in the same
    document. ``repeats`` are the maximal repeats, as word positions here and at an earlier place (the first one, or the first
    that the same task had met). Null and empty texts have no words. A null doc_id sorts before all others, and is null as ``first_doc_id``. Rows that repeat a doc_id with
    the same text are one document and get the same result, wherever they lie; with other texts they are told apart, and
    ordered, by a hash of the text. Extra columns are ignored; an empty table gives no rows.
    """
    low = (1 << TAG_SHIFT) - 1
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("repeats", pa.list_(pa.struct([(c, pa.int64()) for c in REPEAT])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = W.texts_of(batch.column(1))
            row, place, n, id_, first, ask = _spans(batch.column(2), ("place", "n", "first_id", "first_place", "ask"))
            row, place, n, id_, first = (x[~ask.astype(bool)] for x in (row, place, n, id_, first))
            late = _spans(batch.column(3), ("place", "first_id", "first_place"))
            row, place, n, id_, first = (np.concatenate(x) for x in ((row, late[0]), (place, late[1]), (n, np.ones(len(late[0]), np.int64)), (id_, late[2]), (first, late[3])))
            tags = np.zeros(len(texts), np.int64)
            for i in np.unique(row).tolist():
                tags[i] = _tag(texts[i])
            start, mine = place - tags[row], place >> TAG_SHIFT == tags[row] >> TAG_SHIFT  # of rows that share a doc_id, each takes its own
            row, start, size, id_, first = maximal(row[mine], start[mine], n[mine], id_[mine], first[mine] & low, window)
            ends = np.searchsorted(row, np.arange(len(texts) + 1))
            counts, gone, kept = [], [], []
            for t, a, b in zip(texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                words, left = t.split(), 0
                if a < b:
                    stay = ~W.covered(start[a:b], size[a:b], len(words))
                    left = len(words) - int(stay.sum())
                    words = [words[i] for i in np.flatnonzero(stay).tolist()]
                counts.append(len(words) + left)
                gone.append(left)
                kept.append(b" ".join(words))
            fields = [pa.array(start), pa.array(size), pa.array(id_, mask=id_ == NO_ID), pa.array(first)]
            repeats = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays(fields, list(REPEAT)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), repeats], schema=schema)

    rows = repeated(docs, text, window, anchor).select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "text", "marks", "late")
    return rows.mapInArrow(run, KEPT)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
