"""Vector kernels on text bytes, shared by the operators: words, their hashes, and rolling hashes of word runs.

Words are the runs of bytes other than blank and 09 to 0D.  A word's hash is a polynomial over its bytes modulo
2**64, taken from running sums; a run's hash is the same over the hashes of its words.  No Python loop runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE, WORD_BASE = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
CHUNK = 1 << 20
"""Bytes hashed at a time; a longer word widens its own chunk only."""

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
MARK = np.zeros(256, bool)
MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _inverse(odd: np.uint64) -> np.uint64:
    """Inverse of an odd number modulo 2**64."""
    return U(pow(int(odd), -1, 1 << 64))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base`` to the powers 0 .. n-1, modulo 2**64 (kept between calls)."""
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        size = max(n, 1 << 16)
        known = np.full(size, base, U)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if size <= 4 * CHUNK:
            _POWERS[int(base)] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def slices(texts: list[bytes], limit: int = 2 * CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes; a longer text stands alone."""
    start = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > limit:
            yield start, i
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield start, len(texts)


class Words:
    """The words of some texts: byte ``start`` and ``end`` in ``data``, ``hash``, ``doc``; ``first[d]`` is the first word of text d."""

    def __init__(self, texts: list[bytes], lower: bool = False, trim: bool = False, prefixes: tuple[int, ...] = ()):
        joined = b"\n".join(texts)
        self.data = np.frombuffer(joined, np.uint8)
        if lower:
            self.data = LOWER[self.data]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.origin = np.concatenate([[0], np.cumsum(lengths + 1)])
        inside = np.zeros(len(self.data) + 2, np.int8)
        inside[1:-1] = ~SPACE[self.data]
        step = np.diff(inside)
        self.start, self.end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.doc = np.searchsorted(self.origin, self.start, "right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        if trim:  # leave out up to three punctuation marks at either end
            for _ in range(3):
                self.end -= MARK[self.data[self.end - 1]] & (self.end - self.start > 1)
                self.start += MARK[self.data[np.minimum(self.start, max(0, len(self.data) - 1))]] & (self.end - self.start > 1)
        self.prefixes = [np.empty(len(self.start), U) for _ in prefixes]
        self.hash = self._hashes(prefixes)

    def _hashes(self, prefixes: tuple[int, ...]) -> np.ndarray:
        out = np.empty(len(self.start), U)
        at = 0
        while at < len(self.start):
            base = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.end, base + CHUNK, "right")))
            stop = self.end[to - 1]
            sums = np.zeros(stop - base + 1, U)
            np.cumsum((self.data[base:stop].astype(U) + U(1)) * powers(BASE, stop - base), out=sums[1:])
            s, e = self.start[at:to] - base, self.end[at:to] - base
            back = powers(_inverse(BASE), stop - base)[s]
            out[at:to] = mix((sums[e] - sums[s]) * back + (e - s).astype(U))
            for k, own in zip(prefixes, self.prefixes):
                own[at:to] = mix((sums[np.minimum(s + k, e)] - sums[s]) * back + U(1000 + k))
            at = to
        return out

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Start word and hash of every run of ``length`` words inside one text."""
        n = len(self.hash) - length + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, U)
        out = np.empty(n, U)
        for at in range(0, n, CHUNK):
            to = min(n, at + CHUNK)
            part = self.hash[at : to + length - 1]
            sums = np.zeros(len(part) + 1, U)
            np.cumsum(part * powers(WORD_BASE, len(part)), out=sums[1:])
            out[at:to] = (sums[length : length + to - at] - sums[: to - at]) * powers(_inverse(WORD_BASE), to - at)
        where = np.flatnonzero(self.doc[:n] == self.doc[length - 1 :])
        return where, mix(out[where])


def code_points(data: np.ndarray) -> np.ndarray:
    """Number of code points before each byte (and after the last), so byte offsets become character offsets."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def out_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def flat(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
