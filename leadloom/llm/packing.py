"""Best-two-fit packing of tokenised documents into sequences.

Token counts are small, so only they are shuffled: documents are tokenised where they are read, dealt by a hash of their
place into groups of a given mean size, and each group is packed by itself. A document over the limit is cut so that only its first piece can be
short; its full pieces are sequences of their own and take no part in the search.
"""

from __future__ import annotations

import json
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LIMIT = 2048
#: Documents packed together in one task, on average; more would not make fewer sequences by any measurable share.
GROUP = 16384
#: Characters above which a text is left to the tokenizers library, whose matcher has no limit on runs of white space.
LONG_TEXT = 1 << 20


class Encoder:
    """Ids of a byte-level BPE vocabulary given as a tokenizers file.

    Where the file's ids follow its merges, texts go through tiktoken with ranks made from the file, which gives the same
    ids several times faster. Texts with a special token's string, very long texts and other files go through tokenizers.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole, self.fast = Tokenizer.from_file(path), None
        with open(path) as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"].get("merges") or []
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
        if (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec.get("normalizer") and all(vocab.get(x) == 256 + k for k, x in enumerate(joined)):
            import public_tokenizers
            import tiktoken

            plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
            rest = [b for b in range(256) if b not in plain]
            byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
            ranks = {bytes(byte[c] for c in x): i for x, i in vocab.items() if x not in self.special}
            self.fast = tiktoken.Encoding("from-file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.fast and len(text) <= LONG_TEXT and not any(x in text for x in self.special):
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.whole.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes() if sys.byteorder != "little" else array("I", ids).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(n: int, limit: int) -> list[int]:
    """Where the pieces of n tokens begin; the first piece may be shorter, the others are full."""
    return [0, *range(n % limit or limit, n, limit)]


def tokenised(docs: DataFrame, tokenizer: str, limit: int, text: str) -> DataFrame:
    """``(doc_id, n_tokens, crcs)`` per row: tokens with the end id 0, and the CRC-32 of each piece's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            sizes, crcs = [], []
            for t in batch.column(1).to_pylist():
                ids = encode(t or "") + b"\0\0\0\0"
                n = len(ids) // 4
                at = [*cuts(n, limit), n]
                sizes.append(n)
                crcs.append([zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(at, at[1:], strict=False)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["doc_id", "n_tokens", "crcs"])

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, crcs array<long>")


def best_two_fit(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each size (1..limit), and the number of bins.

    A bin takes the largest unpacked document that fits, again and again. When none fits, its smallest document goes back
    if two unpacked ones fill the gap that opens more tightly; the pair with the largest sum that fits is taken.
    """
    order = np.argsort(-sizes, kind="stable")
    stock: list[list[int]] = [[] for _ in range(limit + 1)]
    for i in order[::-1].tolist():
        stock[sizes[i]].append(i)
    count = np.array([len(x) for x in stock])
    lengths = np.arange(limit + 1)

    def largest() -> np.ndarray:
        return np.maximum.accumulate(np.where(count > 0, lengths, 0))

    best = largest()
    bins = np.empty(len(sizes), np.int64)
    offsets = np.empty(len(sizes), np.int64)
    n_bins, left = 0, len(sizes)

    def take(size: int) -> int:
        nonlocal best, left
        count[size] -= 1
        left -= 1
        if not count[size]:
            best = largest()
        return stock[size].pop()

    while left:
        inside: list[tuple[int, int]] = []
        gap = limit
        while left and (size := int(best[gap])):
            inside.append((size, take(size)))
            gap -= size
        while gap and left > 1 and inside:
            size, i = min(inside)
            room = gap + size
            first = np.flatnonzero(count[: room + 1])
            first = first[first > 0]
            second = best[room - first] if len(first) else first
            single = (second == first) & (count[first] < 2)
            if single.any():
                second = second.copy()
                second[single] = best[np.minimum(room - first[single], first[single] - 1)]
            total = np.where(second > 0, first + second, 0)
            k = int(np.argmax(total)) if len(total) else -1
            if k < 0 or total[k] <= size:
                break
            pair = int(first[k]), int(second[k])
            inside.remove((size, i))
            inside += [(s, take(s)) for s in pair]
            stock[size].append(i)
            count[size] += 1
            left += 1
            best = largest()
            gap = room - sum(pair)
        at = 0
        for size, i in inside:
            bins[i], offsets[i] = n_bins, at
            at += size
        n_bins += 1
    return bins, offsets, n_bins


def dealt(rows: DataFrame, n_groups: int) -> DataFrame:
    """``rows`` with ``group``, 0 to ``n_groups - 1``: by a hash of partition and place in it, so even for any number of either."""
    return rows.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_groups)).cast("long"))


def packed(docs: DataFrame, tokenizer: str, limit: int = LIMIT, text: str = "text", group: int = GROUP) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null and empty texts are one token, the end id. Rows that repeat, or share a doc_id, are packed each. A null doc_id
    stays null. Extra columns of ``docs`` are ignored; an empty table gives no rows.
    """
    n_groups = max(1, -(-docs.count() // group))
    kind = dict(docs.dtypes)["doc_id"]

    def run(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        n = part.column("n_tokens").to_numpy()
        head = (n - 1) % limit + 1
        short = head < limit
        sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        bins, at, used = best_two_fit(head[short], limit)
        sequence[short], offset[short] = bins, at
        full = (n - head) // limit + ~short
        base = used + np.cumsum(full) - full
        first = key[0].as_py() << 32
        sequence = np.where(short, sequence, base) + first
        return pa.table({"doc_id": part.column("doc_id"), "n_tokens": n, "crcs": part.column("crcs"), "head": head, "sequence": sequence, "offset": offset, "base": base + first + ~short})

    placed = dealt(tokenised(docs, tokenizer, limit, text), n_groups).groupBy("group").applyInArrow(run, f"doc_id {kind}, n_tokens long, crcs array<long>, head long, sequence long, offset long, base long")
    piece = F.col("piece").cast("long")
    return placed.select("doc_id", "head", "sequence", "offset", "base", F.posexplode("crcs").alias("piece", "ids_crc32")).select(
        "doc_id",
        "piece",
        F.when(piece == 0, F.lit(0)).otherwise(F.col("head") + (piece - 1) * limit).cast("long").alias("start"),
        F.when(piece == 0, F.col("head")).otherwise(F.lit(limit)).cast("long").alias("length"),
        "ids_crc32",
        F.when(piece == 0, F.col("sequence")).otherwise(F.col("base") + piece - 1).alias("sequence_id"),
        F.when(piece == 0, F.col("offset")).otherwise(F.lit(0)).cast("long").alias("offset"),
    )


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
