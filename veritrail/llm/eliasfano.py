"""Elias-Fano sequences in numpy, and a two-level trie of them in one memory-mapped file."""

from __future__ import annotations

import os
import tempfile
from dataclasses import dataclass

import numpy as np

_U = np.uint64


@dataclass
class EliasFano:
    """A non-decreasing sequence: low bits packed, high parts in unary, zeros counted per word."""

    n: int
    width: int
    low: np.ndarray  # uint8, padded by 8 bytes
    high: np.ndarray  # uint64 words
    zeros: np.ndarray  # zeros before each word, uint32

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = values.astype(np.uint64)
        n = len(v)
        top = int(v[-1]) + 1 if n else 1
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros((n * width + 7) // 8 + 8, np.uint8)
        if width and n:
            part = v & _U((1 << width) - 1)
            bits = ((part[:, None] >> np.arange(width, dtype=np.uint64)) & _U(1)).astype(np.uint8).ravel()
            packed = np.packbits(bits, bitorder="little")
            low[: len(packed)] = packed
        upper = (v >> _U(width)).astype(np.int64)
        size = int(upper[-1]) + n + 1 if n else 1
        marks = np.zeros(-(-size // 64) * 64, bool)
        marks[upper + np.arange(n)] = True
        high = np.packbits(marks, bitorder="little").view(np.uint64)
        zeros = np.concatenate(([0], np.cumsum(64 - np.bitwise_count(high).astype(np.int64)))).astype(np.uint32)
        return cls(n, width, low, high, zeros)

    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.high, self.zeros]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        bit = i * self.width
        view = np.lib.stride_tricks.as_strided(self.low[:8].view(np.uint64), (len(self.low) - 7,), (1,))
        return (view[bit >> 3] >> (bit & 7).astype(np.uint64)) & _U((1 << self.width) - 1)

    def _in_word(self, word: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Place of the k-th set bit (from 0) of each word, by halving."""
        at = np.zeros(len(word), np.uint64)
        k = k.copy()
        for half in (32, 16, 8, 4, 2, 1):
            c = np.bitwise_count((word >> at) & _U((1 << half) - 1)).astype(np.int64)
            right = k >= c
            k -= np.where(right, c, 0)
            at += np.where(right, _U(half), _U(0))
        return at.astype(np.int64)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero among the high bits; past the last one, the end."""
        w = np.minimum(np.searchsorted(self.zeros, k, "right") - 1, len(self.high) - 1)
        return w * 64 + self._in_word(~self.high[w], k - self.zeros[w].astype(np.int64))

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """Values at places i."""
        ones = np.arange(len(self.zeros)) * 64 - self.zeros.astype(np.int64)
        w = np.searchsorted(ones, i, "right") - 1
        bit = w * 64 + self._in_word(self.high[w], i - ones[w])
        return ((bit - i).astype(np.uint64) << _U(self.width)) | self._low(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of the first value >= x (its successor), n if there is none."""
        x = x.astype(np.uint64)
        part = (x >> _U(self.width)).astype(np.int64)
        beyond = part >= int(self.zeros[-1])
        h = np.where(beyond, 0, part)
        before = self._zero(np.maximum(h - 1, 0)) + 1 - h
        a = np.where(h > 0, before, 0)
        b = np.minimum(self._zero(h) - h, self.n)
        want = x & _U((1 << self.width) - 1)
        open_ = np.flatnonzero(a < b)
        while len(open_):
            mid = (a[open_] + b[open_]) >> 1
            less = self._low(mid) < want[open_]
            a[open_] = np.where(less, mid + 1, a[open_])
            b[open_] = np.where(less, b[open_], mid)
            open_ = open_[a[open_] < b[open_]]
        return np.where(beyond, self.n, a)


def to_file(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """The arrays, written to one file and mapped read-only; the file has no name any more."""
    fd, path = tempfile.mkstemp(prefix="levels-")
    try:
        with os.fdopen(fd, "wb") as f:
            at = []
            for a in arrays:
                f.write(b"\0" * (-f.tell() % 8))
                at.append(f.tell())
                f.write(np.ascontiguousarray(a).tobytes())
            f.write(b"\0" * 8)
        mapped = np.memmap(path, np.uint8, "r")
    finally:
        os.unlink(path)
    return [mapped[p : p + a.nbytes].view(a.dtype) for p, a in zip(at, arrays)]


class Trie:
    """Contexts, and below each its successors with a code.

    contexts: sorted; pointers: where each one's successors begin (monotone); successors: ids
    made monotone by adding the last value of the context before, so one sequence holds all and
    an id is sought relative to its context.
    """

    def __init__(self, context: np.ndarray, word: np.ndarray, code: np.ndarray, book: np.ndarray):
        """Pairs sorted by context, then word, without repeats."""
        own, first = np.unique(context, return_index=True)
        ends = np.append(first[1:], len(context)).astype(np.int64) if len(context) else np.zeros(0, np.int64)
        tops = word[ends - 1].astype(np.int64) + 1 if len(ends) else np.zeros(0, np.int64)
        base = np.concatenate(([0], np.cumsum(tops)))[:-1]
        shifted = word.astype(np.int64) + np.repeat(base, np.diff(np.append(first, len(context))))
        levels = [EliasFano.encode(own), EliasFano.encode(np.append(first, len(context))), EliasFano.encode(shifted)]
        mapped = to_file([a for level in levels for a in level.arrays()] + [code, book])
        self.contexts, self.pointers, self.successors = (EliasFano(level.n, level.width, *mapped[3 * k : 3 * k + 3]) for k, level in enumerate(levels))
        self.code, self.book = mapped[-2], mapped[-1]
        self.bytes = sum(a.nbytes for a in mapped)

    def lookup(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The value of each pair, 0 for absent ones; pairs come sorted by context."""
        out = np.zeros(len(context))
        if not self.contexts.n or not len(context):
            return out
        own, inverse = np.unique(context, return_inverse=True)
        at = self.contexts.find(own)
        there = at < self.contexts.n
        there[there] = self.contexts[at[there]] == own[there].astype(np.uint64)
        at = np.where(there, at, 0)
        low, high = self.pointers[at].astype(np.int64), self.pointers[at + 1].astype(np.int64)
        base = np.zeros(len(own), np.int64)
        later = np.flatnonzero(low > 0)
        # the last value of the context before, plus one
        base[later] = self.successors[low[later] - 1].astype(np.int64) + 1
        ask = np.flatnonzero(there[inverse])
        who = inverse[ask]
        want = base[who] + word[ask].astype(np.int64)
        got = self.successors.find(want)
        ok = got < high[who]
        ok[ok] = self.successors[got[ok]] == want[ok].astype(np.uint64)
        out[ask[ok]] = self.book[self.code[got[ok]]]
        return out
