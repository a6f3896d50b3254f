"""Vectorised text kernels: words, rolling hashes and n-grams over Arrow string buffers.

A batch of texts is worked on as one byte array with document offsets, in
slices of about SLICE bytes (a longer text is a slice of its own), so memory
follows the longest text and not the batch.

Hashes are polynomials modulo 2**64 over random byte values with an odd base;
the base has an inverse, so the hash of any span is a difference of prefix sums
times an inverse power. A finaliser spreads the bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 18
#: Powers that a worker keeps at most.
MOST_KEPT = 1 << 21
U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
SPACE_BYTES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE_BYTES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

BYTE_VALUE = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
BYTE_VALUE_LOWER = BYTE_VALUE[LOWER]

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n at least; those of very long texts are not kept."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE + 8)
        made = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        if size > MOST_KEPT:
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, last + 1, bytes, offsets from 0) of slices of a string array; null reads as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, off, data = texts.buffers()
    n = len(texts)
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


class Words:
    """Runs of bytes that are no gaps (x09-x0D and x20 unless told) of a slice, in order, never across documents.

    ``first[d]:first[d + 1]`` are the words of document d; start and end are byte positions.
    """

    def __init__(self, b: np.ndarray, offs: np.ndarray, gaps: np.ndarray = IS_SPACE):
        gap = gaps[b]
        s = ~gap
        e = s.copy()
        begin = offs[:-1][offs[:-1] < offs[1:]]
        last = offs[1:][offs[:-1] < offs[1:]] - 1
        solid_begin, solid_last = s[begin], s[last]
        if len(b) > 1:
            e[:-1] &= gap[1:]
            s[1:] &= gap[:-1]
        s[begin] = solid_begin
        e[last] = solid_last
        self.start = np.flatnonzero(s)
        self.end = np.flatnonzero(e) + 1
        self.first = np.searchsorted(self.start, offs)
        self.count = np.diff(self.first)

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def lowered(b: np.ndarray) -> np.ndarray:
    """Lower-cases A-Z and, in UTF-8, the capitals of Latin-1."""
    c = LOWER[b]
    if len(c) > 1:
        tail = c[1:]
        tail[(c[:-1] == 0xC3) & (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)] += 0x20
    return c


def prefix_sums(b: np.ndarray, value: np.ndarray = BYTE_VALUE) -> np.ndarray:
    p, _ = powers(len(b) + 1)
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(value[b] * p[: len(b)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inv = powers(len(sums))
    return mixed((sums[end] - sums[start]) * inv[start] + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))


_STEP = np.random.default_rng(77003).integers(1, 1 << 63, 16, dtype=np.uint64) * U(2) + U(1)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k neighbours of h; len(h) - k + 1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * _STEP[0]
    for i in range(1, k):
        out += h[i : i + n] * _STEP[i]
    return mixed(out)


def in_one_doc(first: np.ndarray, total: int, k: int) -> np.ndarray:
    """Which of the total - k + 1 runs of k words stay in one document."""
    n = max(0, total - k + 1)
    ok = np.ones(n, bool)
    for j in range(1, k):
        at = first[1:-1] - j
        ok[at[(at >= 0) & (at < n)]] = False
    return ok


def hash_text(words: str, value: np.ndarray = BYTE_VALUE) -> int:
    """Hash of one string, as span_hashes gives it."""
    b = np.frombuffer(words.encode(), np.uint8)
    return int(span_hashes(prefix_sums(b, value), np.array([0]), np.array([len(b)]))[0]) if len(b) else int(mixed(np.zeros(1, np.uint64))[0])
