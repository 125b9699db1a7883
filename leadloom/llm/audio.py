"""Chroma audio fingerprints and alignment of recordings.

PCM is folded to twelve pitch classes per frame; rectangle filters over an integral image of these frames give 16 values of
two bits, packed into one integer per frame. Recordings that share packed integers vote for a time offset; the offset with
the most votes is checked by the share of differing bits over the overlap.

Two recordings are linked if, at the offset where most of their integers are equal (two at least), few of their bits differ. Classes
are the connected components of these links, and are exact. Recordings that share runs of integers are compared first, and their links
give classes. Then all recordings of different classes that have two equal integers at one offset are compared, so a link is left out
only where the links that were found join its ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, saved, table

RATE = 8000
FRAME, HOP = 1024, 512
LOW_HZ, HIGH_HZ = 180.0, 3500.0
SPAN = 16
#: Frames transformed at once, and recordings sent at once: what a task holds does not grow with its input.
BLOCK, SENT = 512, 64
#: Lengths of the runs of integers that are looked up first. Holders of an integer outside its largest class that all meet by it alone.
RUNS, FEW = (2, 3, 4, 6), 32
#: Integers compared at once where pairs are aligned.
COMPARED = 1 << 20
#: An offset counts if so many frames agree there; an alignment holds up to this share of differing bits over this overlap.
MIN_VOTES = 2
MAX_BIT_ERROR = 0.2
MIN_OVERLAP = 16
#: Thresholds of the two bits, and their Gray code.
STEPS = np.array([-0.12, 0.0, 0.12])
GRAY = np.array([0, 1, 3, 2], np.uint32)


def filters() -> list[tuple[int, int, int, int]]:
    """Shape (0 pitch halves, 1 time halves, 2 quadrants, 3 middle against sides), first pitch class, height and width of the 16."""
    return [(k % 4, 3 * k % 8, 4, SPAN // 2 if k < 8 else SPAN) for k in range(16)]


def _fold() -> np.ndarray:
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(hz), 12))
    use = np.flatnonzero((hz >= LOW_HZ) & (hz <= HIGH_HZ))
    out[use, np.rint(12 * np.log2(hz[use] / 440.0)).astype(int) % 12] = 1.0
    return out


FOLD, TAPER = _fold().astype(np.float32), np.hanning(FRAME).astype(np.float32)


def chroma(pcm: np.ndarray) -> np.ndarray:
    """Pitch-class energies per frame of recordings of one length (a row each), smoothed over five frames and scaled to length 1; silent frames are zero."""
    if pcm.shape[1] < FRAME:
        return np.zeros((len(pcm), 0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(pcm, FRAME, axis=1)[:, ::HOP]
    energy, step = np.empty((*frames.shape[:2], 12)), max(1, BLOCK // len(pcm))
    for k in range(0, frames.shape[1], step):
        bins = np.fft.rfft(frames[:, k : k + step] * TAPER)
        energy[:, k : k + step] = (bins.real**2 + bins.imag**2) @ FOLD
    padded = np.pad(energy, ((0, 0), (2, 2), (0, 0)))
    energy = sum(w * padded[:, i : i + energy.shape[1]] for i, w in enumerate((0.25, 0.75, 1.0, 0.75, 0.25)))
    norm = np.linalg.norm(energy, axis=2, keepdims=True)
    return np.divide(energy, norm, out=np.zeros_like(energy), where=norm > 1e-6)


def codes(frames: np.ndarray) -> np.ndarray:
    """One 32-bit integer for every run of 16 frames of each recording, as signed 32-bit."""
    n = frames.shape[1] - SPAN + 1
    if n <= 0:
        return np.zeros((len(frames), 0), np.int32)
    image = np.zeros((len(frames), frames.shape[1] + 1, 13))
    image[:, 1:, 1:] = frames.cumsum(1).cumsum(2)

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        late, early = image[:, t1 : t1 + n], image[:, t0 : t0 + n]
        return (late[:, :, y1] - early[:, :, y1] - late[:, :, y0] + early[:, :, y0]) / ((t1 - t0) * (y1 - y0))

    out = np.zeros((len(frames), n), np.uint32)
    for shape, y, h, w in filters():
        ym, tm = y + h // 2, w // 2
        if shape == 0:
            a, b = area(0, w, y, ym), area(0, w, ym, y + h)
        elif shape == 1:
            a, b = area(0, tm, y, y + h), area(tm, w, y, y + h)
        elif shape == 2:
            a = (area(0, tm, y, ym) + area(tm, w, ym, y + h)) / 2
            b = (area(tm, w, y, ym) + area(0, tm, ym, y + h)) / 2
        else:
            a, b = area(w // 4, w - w // 4, y, y + h), (area(0, w // 4, y, y + h) + area(w - w // 4, w, y, y + h)) / 2
        out = (out << np.uint32(2)) | GRAY[np.searchsorted(STEPS, np.log1p(a) - np.log1p(b))]
    return out.view(np.int32)


def listened(sounds: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Frames and integers of each recording; those of one length are worked out together."""
    sizes, out = np.zeros(len(sounds), np.int32), [np.zeros(0, np.int32)] * len(sounds)
    by_length: dict[int, list[int]] = {}
    for i, raw in enumerate(sounds):
        by_length.setdefault(len(raw) // 2, []).append(i)
    for length, places in by_length.items():
        for k in range(0, len(places), SENT):
            part = places[k : k + SENT]
            pcm = np.stack([np.frombuffer(sounds[i], "<i2", length) for i in part]).astype(np.float32) / np.float32(32768)
            frames = chroma(pcm)
            sizes[part] = frames.shape[1]
            for i, c in zip(part, codes(frames), strict=True):
                out[i] = c
    return sizes, out


def fingerprints(recordings: DataFrame, pcm: str = "pcm") -> DataFrame:
    """``(rec_id, n_frames, fp)`` of ``recordings(rec_id, pcm)``: 16-bit little-endian mono PCM at 8 kHz, fp array<int>.

    A null, empty or too short recording has an empty fp. Repeated rows are fingerprinted each. Extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, fps = listened([raw or b"" for raw in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(fps, pa.list_(pa.int32()))], ["rec_id", "n_frames", "fp"])

    return recordings.select(F.col("rec_id").cast("long").alias("rec_id"), pcm).mapInArrow(run, "rec_id long, n_frames int, fp array<int>")


def partners(fps: DataFrame) -> DataFrame:
    """Pairs ``(a, b)``, b < a, that share a run of integers: those that are compared first, so that large classes are known early.

    The holders of a run meet four of them, the ends of two orders (by rec_id and by its hash), so the pairs grow with the holders and
    not with their square. Holders that this leaves in different classes meet each other in ``between``.
    """
    posts = fps.select("rec_id", F.posexplode("fp").alias("frame", "code"), "fp")
    run = lambda k: F.slice("fp", F.col("frame") + 1, F.lit(k))
    keys = F.array_compact(F.array(*[F.when(F.size("fp") - F.col("frame") >= k, F.struct(F.lit(k).alias("k"), F.xxhash64(run(k)).alias("key"))) for k in RUNS]))
    posts = saved(posts.select("rec_id", F.inline(keys)).distinct(), "audio-posts")
    mixed = F.xxhash64("rec_id")
    hubs = F.array_distinct(F.array(F.min("rec_id"), F.max("rec_id"), F.min_by("rec_id", mixed), F.max_by("rec_id", mixed)))
    hubs = saved(posts.groupBy("k", "key").agg(hubs.alias("hubs")).where(F.size("hubs") > 1), "audio-hubs")
    met = posts.join(hubs, ["k", "key"]).select("rec_id", F.explode("hubs").alias("b")).where("rec_id <> b")
    return met.select(F.greatest("rec_id", "b").alias("a"), F.least("rec_id", "b").alias("b")).distinct()


def between(fps: DataFrame, groups: DataFrame) -> DataFrame:
    """All pairs ``(a, b)``, b < a, of different classes with two equal integers at one offset (and perhaps some others); ``groups(node, component)``.

    An integer with ``FEW`` holders or less outside its largest class brings together all its holders of different classes. They stay if
    they meet twice at one offset, or once where a common integer stands at one distance in both. Two common integers at one distance
    are a key of their own, of which all holders of different classes meet, however many they are.
    """
    own = fps.join(groups.select(F.col("node").alias("rec_id"), "component"), "rec_id", "left")
    own = own.select("rec_id", F.coalesce("component", "rec_id").alias("class_id"), F.size("fp").alias("length"), F.posexplode("fp").alias("frame", "code"))
    posts = saved(own, "audio-codes")
    held = posts.groupBy("code", "class_id").agg(F.count("*").alias("n")).groupBy("code").agg((F.sum("n") - F.max("n")).alias("others")).where("others > 0")
    held = saved(held.select("code", (F.col("others") > FEW).alias("common")), "audio-held")
    posts = posts.join(held, "code").groupBy("rec_id", "class_id", "length").agg(F.sort_array(F.collect_list(F.struct("frame", "code", "common"))).alias("at"))
    posts = saved(posts.withColumns({"few": F.filter("at", lambda x: ~x.common), "many": F.filter("at", lambda x: x.common)}).drop("at"), "audio-frames")

    def met(df: DataFrame, key: str) -> DataFrame:
        """Rows of one key, of different classes, at an offset where they overlap enough."""
        other = df.select(key, *[F.col(c).alias(f"{c}_b") for c in df.columns if c != key])
        rows = df.join(other, key).where("rec_id > rec_id_b and class_id <> class_id_b").withColumn("offset", F.col("frame") - F.col("frame_b"))
        overlap = F.least(F.col("length") - F.greatest("offset", F.lit(0)), F.col("length_b") + F.least("offset", F.lit(0)))
        return rows.where(overlap >= MIN_OVERLAP).withColumnsRenamed({"rec_id": "a", "rec_id_b": "b"})

    one = posts.select("rec_id", "class_id", "length", "many", F.explode("few").alias("x")).select("rec_id", "class_id", "length", "x.frame", "x.code", "many")
    one = one.withColumn("beside", F.transform("many", lambda m: F.hash(m.frame - F.col("frame"), m.code))).drop("many")
    once = met(saved(one, "audio-few"), "code").groupBy("a", "b", "offset").agg(F.count("*").alias("votes"), F.max(F.arrays_overlap("beside", "beside_b")).alias("more"))
    once = once.where((F.col("votes") >= MIN_VOTES) | F.col("more"))
    after = lambda i: F.slice("many", i + 2, F.size("many"))
    twos = F.flatten(F.transform("many", lambda x, i: F.transform(after(i), lambda y: F.struct(x.frame.alias("frame"), F.xxhash64(x.code, y.code, y.frame - x.frame).alias("key")))))
    two = saved(posts.where(F.size("many") > 1).select("rec_id", "class_id", "length", F.inline(twos)), "audio-twos")
    keys = saved(two.groupBy("key").agg(F.min("class_id").alias("lo"), F.max("class_id").alias("hi")).where("lo <> hi").select("key"), "audio-keys")
    twice = met(saved(two.join(keys, "key"), "audio-many"), "key")
    return once.select("a", "b").union(twice.select("a", "b")).distinct()


def best(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offset of each row of ``y`` in that of ``x`` where most integers are equal, and how many (ties: the nearest to 0, then the larger)."""
    n, m = x.shape[1], y.shape[1]
    at, votes = np.zeros(len(x), np.int32), np.zeros(len(x), np.int32)
    for o in sorted(range(1 - m, n), key=lambda o: (abs(o), -o)):
        start, shift = max(o, 0), max(-o, 0)
        k = min(n - start, m - shift)
        equal = np.count_nonzero(x[:, start : start + k] == y[:, shift : shift + k], axis=1)
        more = equal > votes
        at[more], votes[more] = o, equal[more]
    return at, votes


def compared(x: pa.ListArray, y: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best offset, votes, overlap and differing bits of pairs of fingerprints; those of equal lengths are worked out together."""
    flat, ends = [c.values.to_numpy() for c in (x, y)], [c.offsets.to_numpy() for c in (x, y)]
    sizes = np.stack([np.diff(e) for e in ends], axis=1)
    at, votes, wrong = (np.zeros(len(x), np.int32) for _ in range(3))
    for n, m in np.unique(sizes, axis=0):
        rows = np.flatnonzero((sizes == (n, m)).all(axis=1))
        step = max(1, COMPARED // max(1, n, m))
        for part in (rows[k : k + step] for k in range(0, len(rows), step)):
            p, q = (f[e[part][:, None] + np.arange(k)] for f, e, k in zip(flat, ends, (n, m), strict=True))
            at[part], votes[part] = best(p, q)
            for o in np.unique(at[part]):
                same, start, shift = at[part] == o, max(o, 0), max(-o, 0)
                k = min(n - start, m - shift)
                differ = p[same, start : start + k] ^ q[same, shift : shift + k]
                wrong[part[same]] = np.bitwise_count(differ.view(np.uint32)).sum(axis=1)
    overlap = np.minimum(sizes[:, 0] - np.maximum(at, 0), sizes[:, 1] - np.maximum(-at, 0)).astype(np.int32)
    return at, votes, overlap, wrong


def alignments(pairs: DataFrame, fps: DataFrame) -> DataFrame:
    """Verified alignments ``(a, b, offset, votes, overlap, bit_error)`` among ``pairs(a, b)`` of ``fps(rec_id, fp)``, each fingerprint of a with each of b.

    ``offset`` is where b's first frame falls in a; it and ``votes`` are found from all integers of both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = compared(batch.column(2), batch.column(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, found)], ["a", "b", "offset", "votes", "overlap", "wrong"])

    met = saved(pairs, "audio-pairs")
    met = met.join(fps.select(F.col("rec_id").alias("a"), F.col("fp").alias("x")), "a").join(fps.select(F.col("rec_id").alias("b"), F.col("fp").alias("y")), "b")
    met = met.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, offset int, votes int, overlap int, wrong int")
    met = met.where((F.col("votes") >= MIN_VOTES) & (F.col("overlap") >= MIN_OVERLAP))
    return met.select("a", "b", "offset", "votes", "overlap", F.round(F.col("wrong") / (32.0 * F.col("overlap")), 6).alias("bit_error")).where(F.col("bit_error") <= MAX_BIT_ERROR)


def aligned(recordings: DataFrame, pcm: str = "pcm") -> DataFrame:
    """One row per recording: ``rec_id, n_frames, fp_sha256, class_id, aligned_to, offset, bit_error``.

    Recordings with equal fingerprints are one node, the smallest rec_id; classes are components of verified alignments,
    named by their smallest rec_id. ``aligned_to`` is, of the alignments that were worked out, the smaller recording with the lowest bit
    error (ties: the smallest), null if none; these join each class, but of a large class they are not all pairs. For a copy it is the
    first recording with its fingerprint, at offset 0. A recording without fingerprint, or with a null rec_id and no copy, is a class
    of its own. Rows that share a rec_id with other audio are further recordings of one node, and are all compared.
    """
    digest = F.when(F.size("fp") > 0, F.sha2(F.array_join("fp", ","), 256))
    fps = saved(fingerprints(recordings, pcm).withColumn("fp_sha256", digest), "audio-fp")
    nodes = saved(fps.where("fp_sha256 is not null and rec_id is not null").groupBy("fp_sha256").agg(F.min("rec_id").alias("node"), F.first("fp").alias("fp")), "audio-node")
    one = nodes.select(F.col("node").alias("rec_id"), "fp")
    links = saved(alignments(partners(one), one), "audio-links")
    groups = saved(components(links.select("a", "b"), "audio-groups"), "audio-classes")
    links = saved(links.union(alignments(between(one, groups), one)), "audio-all")
    groups = components(links.select("a", "b"), "audio-groups")
    nearest = links.groupBy("a").agg(F.min(F.struct("bit_error", "b", "offset")).alias("near"))
    known = nodes.select("fp_sha256", "node").join(groups, "node", "left").join(nearest, F.col("node") == F.col("a"), "left")
    known = known.select("fp_sha256", "node", F.coalesce("component", "node").alias("class_id"), "near")
    rows = fps.drop("fp").join(known, "fp_sha256", "left")
    copy = F.col("rec_id") != F.col("node")
    return rows.select(
        "rec_id", "n_frames", "fp_sha256", F.coalesce("class_id", "rec_id").alias("class_id"),
        F.when(copy, F.col("node")).otherwise(F.col("near.b")).alias("aligned_to"),
        F.when(copy, F.lit(0)).otherwise(F.col("near.offset")).alias("offset"),
        F.when(copy, F.lit(0.0)).otherwise(F.col("near.bit_error")).alias("bit_error"),
    )


NOTE = 512


def played(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Recordings ``(rec_id, pcm)`` made of vectors: each component is a note of 64 ms, its pitch the value in steps of a tenth, a fourth apart.

    A null or empty vector is a recording without sound; null and odd components count as 0. Repeated rows give repeated
    recordings; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.arange(NOTE) / RATE
        pitch = 5 * np.arange(-5, 6)
        tones = 12000 * np.sin(2 * np.pi * 783.99 * 2.0 ** (pitch[:, None] / 12) * t) * np.hanning(NOTE) ** 0.25
        tones = tones.astype("<i2")
        for batch in batches:
            for k in range(0, batch.num_rows, SENT):
                part, sound = batch.slice(k, SENT), []
                for v in part.column(1).to_pylist():
                    x = np.nan_to_num(np.array([c if c is not None else 0.0 for c in v or []], float))
                    sound.append(tones[np.clip(np.rint(x * 10), -5, 5).astype(int) + 5].tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sound, pa.binary())], ["rec_id", "pcm"])

    return vectors.select(F.col(key).cast("long").alias("rec_id"), vector).mapInArrow(run, "rec_id long, pcm binary")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(played(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))
