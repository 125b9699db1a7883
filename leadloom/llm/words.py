"""Words and word hashes of many texts at once, as arrays; used inside tasks on one Arrow batch at a time.

A word is a longest run of bytes other than space and 0x09-0x0D. Its hash is a 64-bit polynomial over its bytes, mixed;
a run of words hashes as a polynomial over the hashes of its words, mixed. Both depend on content only, so the same words
give the same hash in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
BLOCK = 1 << 18
LONG = 512
U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


P = 0x9E3779B97F4A7C15
POW = _powers(P, BLOCK + LONG + 2)
INV = _powers(pow(P, -1, 1 << 64), BLOCK + LONG + 2)
BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(29))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(32))


class Words:
    """The words of a list of texts (bytes): byte ``starts`` and ``ends`` in ``buf``, and ``first[i]:first[i + 1]`` of text i."""

    def __init__(self, texts: list[bytes]):
        self.buf = np.frombuffer(b"\n".join([*texts, b""]) or b"\n", np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        inside = np.empty(len(self.buf) + 1, np.int8)
        inside[0] = 0
        inside[1:] = ~SPACES[self.buf]
        edge = np.diff(inside)
        self.starts = np.flatnonzero(edge == 1)
        self.ends = np.flatnonzero(edge == -1)
        self.inside = inside[1:].view(bool)
        self.first = np.searchsorted(self.starts, self.offsets)

    def sums(self, per_byte: np.ndarray) -> np.ndarray:
        """Sum per text of a value per byte."""
        total = np.concatenate([[0], np.cumsum(per_byte, dtype=np.int64)])
        return np.diff(total[self.offsets])

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self.starts), U)
        for a in range(0, len(self.buf), BLOCK):
            i, j = np.searchsorted(self.starts, (a, a + BLOCK))
            if i == j:
                continue
            part = self.buf[a : a + BLOCK + LONG]
            total = np.zeros(len(part) + 1, U)
            np.cumsum((part.astype(U) + U(1)) * POW[: len(part)], out=total[1:])
            s = self.starts[i:j] - a
            e = np.minimum(self.ends[i:j] - a, len(part))
            out[i:j] = (total[e] - total[s]) * INV[s]
        for k in np.flatnonzero(self.ends - self.starts > LONG):
            out[k] = xxhash.xxh64_intdigest(self.buf[self.starts[k] : self.ends[k]].tobytes())
        return mix(out)


def windows(h: np.ndarray, size: int, base: int = BASES[0]) -> np.ndarray:
    """Hash of every run of ``size`` words, by the hashes of the words; empty if there are fewer."""
    n = max(0, len(h) - size + 1)
    out = np.zeros(n, U)
    for k in range(size):
        out = out * U(base) + h[k : k + n]
    return mix(out)


def inside_text(first: np.ndarray, size: int, n: int) -> np.ndarray:
    """Of the ``n - size + 1`` runs of ``size`` words, those that lie in one text."""
    ok = np.ones(max(0, n - size + 1), bool)
    for stop in first[1:-1]:
        ok[max(0, stop - size + 1) : stop] = False
    return ok


def covered(starts: np.ndarray, size: int | np.ndarray, n: int) -> np.ndarray:
    """Of n words, those in a run that begins at one of ``starts`` and has ``size`` words."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + size, n), -1)
    return np.cumsum(step[:-1]) > 0


def pieces(texts: list[bytes], limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Cut a list of texts into stretches of about ``limit`` bytes; a longer text stands alone."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > limit:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def texts_of(column) -> list[bytes]:
    """A string or binary Arrow column as bytes; null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
