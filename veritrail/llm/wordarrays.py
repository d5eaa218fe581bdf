"""Words of many texts as numpy arrays: boundaries, 64-bit hashes and n-word shingle hashes.

Words are the maximal runs of bytes outside 0x20 and 0x09-0x0D; A-Z counts as a-z in
hashes. A hash depends on the word's bytes alone, so it agrees between tasks and jobs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_TABLE = LOWER.tobytes()

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_BYTE_VALUE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the splitmix64 steps)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse, modulo 2**64; grown as needed."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 2 * len(_powers[0]))
        for k, base in enumerate((_BASE, _INV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins; a null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    _, off, data = texts.buffers()
    if len(texts) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(off, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def blocks(texts: pa.Array, most_bytes: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, begins) of runs of whole texts of about most_bytes."""
    raw, at = text_buffer(texts)
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most_bytes, "right")) - 1)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


@dataclass
class Words:
    """Words of a block: byte starts and ends, and per text the first word's number."""

    raw: np.ndarray
    at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, raw: np.ndarray, at: np.ndarray, between: np.ndarray = SPACE) -> Words:
        """between: for each byte, whether it parts words."""
        inside = ~between[raw]
        n = len(raw)
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = inside[:-1]
            after[-1] = False
            after[:-1] = inside[1:]
            cuts = at[(at > 0) & (at < n)]
            before[cuts] = False
            after[cuts - 1] = False
        start = np.flatnonzero(inside & ~before)
        end = np.flatnonzero(inside & ~after) + 1
        return cls(raw, at, start, end, np.searchsorted(start, at))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """For each word, the number of its text in the block."""
        return np.repeat(np.arange(len(self.at) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return self.prefix_hashes([])[0]

    def prefix_hashes(self, sizes: list[int]) -> list[np.ndarray]:
        """Hashes of the words, and of their first bytes for each size (of shorter words, 0)."""
        if not len(self.start):
            return [np.zeros(0, np.uint64) for _ in range(len(sizes) + 1)]
        n = len(self.raw)
        up, down = _power_tables(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[LOWER[self.raw]] * up[:n], out=sums[1:])
        out = [mix((sums[self.end] - sums[self.start]) * down[self.start])]
        for k in sizes:
            cut = np.minimum(self.start + k, n)
            h = mix((sums[cut] - sums[self.start]) * down[self.start] + _U(k))
            out.append(np.where(self.end - self.start > k, h, _U(0)))
        return out

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each run of k words that lies within one text."""
        m = len(hashes) - k + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.zeros(m, np.uint64)
        for i in range(k):
            h = h * _U(0xD6E8FEB86659FD93) + hashes[i : i + m]
        doc = self.doc()
        begin = np.flatnonzero(doc[:m] == doc[k - 1 :])
        return begin, mix(h[begin])


def hash_words(words: list[bytes], k: int) -> np.ndarray:
    """Shingle hashes of one text's words, as Words.windows() makes them."""
    raw = np.frombuffer(b" ".join(words), np.uint8)
    w = Words.of(raw, np.array([0, len(raw)]))
    return w.windows(w.hashes(), k)[1]
