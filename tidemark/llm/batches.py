"""Whole texts as byte arrays inside Arrow tasks: slices, words and rolling hashes.

The helpers work on numpy arrays of one bounded slice of a batch at a time, so a
task's memory follows ``SLICE_BYTES`` (or the longest single text), not the batch.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that are worked on at once.
SLICE_BYTES = 1 << 21
#: Freed memory that a task may keep for its next step.
KEPT_BYTES = 1 << 26
#: Numbers of these settings in malloc.h.
_M_TRIM_THRESHOLD, _M_MMAP_THRESHOLD = -1, -3

U64 = np.uint64
#: Modulus and base of the rolling hashes.
PRIME = U64((1 << 61) - 1)
BASE = 0x1E3779B97F4A7C15 % int(PRIME)
BASE_INVERSE = pow(BASE, -1, int(PRIME))


def separators(*spans: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags: which bytes part words. ``spans`` are inclusive."""
    table = np.zeros(256, dtype=bool)
    for a, b in spans:
        table[a : b + 1] = True
    return table


def white_space() -> np.ndarray:
    return separators((0x20, 0x20), (0x09, 0x0D))


def lower_table() -> np.ndarray:
    """Lower-cases A-Z and leaves every other byte."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def scramble(x: np.ndarray) -> np.ndarray:
    """Mix 64-bit values so that all bits depend on all bits; one-to-one."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def random_values(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    return scramble(scramble(np.arange(1, n + 1, dtype=U64) + U64(seed * 1_000_003)))


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int | None = None):
    """Yield (rows, bytes, offsets) for runs of rows of about ``limit`` text bytes.

    Null texts are empty. Offsets count from the start of the given bytes.
    """
    limit = limit or SLICE_BYTES
    try:
        yield from _slices(batches, column, limit)
    finally:
        give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker is kept for other tasks, next to which its unused memory counts."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def keeping_memory(task: Callable) -> Callable:
    """A map over batches that reuses freed memory, up to ``KEPT_BYTES`` of it, and gives it back at its end.

    By default, arrays of a few hundred kilobytes go back to the system whenever
    they are freed, and are mapped page by page again for the next step.
    """

    @functools.wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choose = getattr(ctypes.CDLL(None), "mallopt", None)
        if choose is not None:
            choose(_M_MMAP_THRESHOLD, KEPT_BYTES // 2)
            choose(_M_TRIM_THRESHOLD, KEPT_BYTES)
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def _slices(batches: Iterator[pa.RecordBatch], column: str, limit: int):
    for batch in batches:
        texts = pc.fill_null(batch.column(column).cast(pa.large_binary()), b"")
        n = len(texts)
        if not n:
            continue
        _, at, data = texts.buffers()
        offsets = np.frombuffer(at, dtype=np.int64)[texts.offset : texts.offset + n + 1]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i), raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j


def _fold(x: np.ndarray) -> np.ndarray:
    """Values below 2**64 modulo the prime."""
    x = (x & PRIME) + (x >> U64(61))
    return np.where(x >= PRIME, x - PRIME, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of values below the prime, modulo the prime, from halves that fit 64 bits."""
    low, high = U64((1 << 31) - 1), U64(31)
    a1, a0, b1, b0 = a >> high, a & low, b >> high, b & low
    middle = a0 * b1 + a1 * b0
    return _fold(((a1 * b1) << U64(1)) + (middle >> U64(30)) + ((middle & U64((1 << 30) - 1)) << high) + a0 * b0)


class Powers:
    """Powers of BASE and of its inverse modulo the prime, grown on demand and kept for a task.

    A prime modulus keeps hashes of long periodic sequences apart, which a power
    of two would not: there, all even factors of a difference add up.
    """

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=U64)
        self.down = np.ones(1, dtype=U64)

    @staticmethod
    def _grown(base: int, n: int) -> np.ndarray:
        out = np.ones(1, dtype=U64)
        while len(out) < n:
            out = np.concatenate([out, _times(out, np.full(1, pow(base, len(out), int(PRIME)), dtype=U64))])
        return out

    def need(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = (self._grown(b, max(n, 1 << 16)) for b in (BASE, BASE_INVERSE))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums of values[i] * BASE**i modulo the prime, with a leading zero."""
        self.need(len(values) + 1)
        terms = _times(_fold(values), self.up[: len(values)])
        high = np.cumsum(terms >> U64(32), dtype=U64)
        out = np.zeros(len(values) + 1, dtype=U64)
        out[1:] = _fold(((high << U64(32)) & PRIME) + (high >> U64(29)) + _fold(np.cumsum(terms & U64(0xFFFFFFFF), dtype=U64)))
        return out

    def raw(self, sums: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        """Sums over spans, the same wherever the span stands, below the prime."""
        return _times(_fold(sums[end] + (PRIME - sums[start])), self.down[start])

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of values[start:end], the same wherever the span stands."""
        return scramble(self.raw(sums, start, end) + (end - start).astype(U64) * U64(0x632BE59BD9B4E019))


#: Values of a byte at each of the first 64 places of a word.
_AT_PLACE = random_values(64 * 256, 11)


def letters(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Running sums, with a leading zero, of a value for each byte of words and its place in the word.

    The values of different places are independent of each other, so the
    difference of two sums tells a word, or its beginning, by its bytes.
    """
    total = int(size.sum())
    kind = np.int32 if len(data) < 1 << 23 else np.int64
    inside = np.arange(total, dtype=kind)
    inside -= np.repeat((np.cumsum(size) - size).astype(kind), size)
    code = np.repeat(start.astype(kind), size)
    code += inside
    code = data[code].astype(kind)
    code |= inside << 8
    out = np.zeros(total + 1, dtype=U64)
    np.take(_AT_PLACE, code, mode="clip", out=out[1:])
    far = np.flatnonzero(code >= len(_AT_PLACE))
    out[far + 1] = scramble(scramble(code[far].astype(U64) + U64(0xA24BAED4963EE407)))
    return np.cumsum(out, dtype=U64, out=out)


class Words:
    """The words of a slice: byte bounds, hash, and the first word of each text.

    ``sums`` and ``at`` give the hash of a word's beginning: sums[at + n] - sums[at].
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, parts: np.ndarray) -> None:
        inside = ~parts[data]
        before = np.zeros(len(data), dtype=bool)
        before[1:] = inside[:-1]
        after = np.zeros(len(data), dtype=bool)
        after[:-1] = inside[1:]
        starts, ends = offsets[:-1], offsets[1:]
        full = starts < ends
        before[starts[full]] = False
        after[ends[full] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        size = self.end - self.start
        self.sums, last = letters(data, self.start, size), np.cumsum(size)
        self.at = last - size
        self.hash = scramble(self.sums[last] - self.sums[self.at] + size.astype(U64) * U64(0x632BE59BD9B4E019))
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k consecutive words, in order, and where each text's begin.

        A text of fewer words, but not none, has its whole sequence as its only one.
        """
        n = len(self.hash)
        mixers = random_values(k, 23) | U64(1)
        lasts = np.repeat(self.first[1:], self.count) - k
        fits = np.arange(n) <= lasts
        at = np.flatnonzero(fits)
        rolled = np.zeros(len(at), dtype=U64)
        for j in range(k):
            rolled += self.hash[at + j] * mixers[j]
        rolled = scramble(rolled)
        each = np.where(self.count >= k, self.count - k + 1, (self.count > 0).astype(np.int64))
        first = np.concatenate([[0], np.cumsum(each)])
        short = np.flatnonzero((self.count > 0) & (self.count < k))
        if len(short):
            out = np.empty(first[-1], dtype=U64)
            place = np.ones(first[-1], dtype=bool)
            place[first[short]] = False
            out[place] = rolled
            value = self.count[short].astype(U64) * U64(0xA0761D6478BD642F)
            for j in range(k - 1):
                has = self.count[short] > j
                value[has] += self.hash[self.first[short[has]] + j] * mixers[j]
            out[first[short]] = scramble(value ^ U64(0x5851F42D4C957F2D))
            rolled = out
        return rolled, first


def signed(x: np.ndarray) -> pa.Array:
    """64-bit values as Arrow longs with the same bits."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))
