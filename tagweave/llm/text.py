"""Vectorised word splitting and word hashing over Arrow string columns.

Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D.  A word's 64-bit hash
is a polynomial over a random table of byte values, mixed with its length; equal words have
equal hashes in every task.  Work is done on slices of about ``SLICE_BYTES``, so memory is
bounded by that or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SOLID = ~_SPACE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_TABLE = np.random.Generator(np.random.PCG64(20240611)).integers(0, 1 << 64, 256, dtype=np.uint64)
_LOWER_TABLE = _TABLE[_LOWER]
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches at rows so that each piece has about ``limit`` bytes of text: (rows, bytes, offsets)."""
    for batch in batches:
        buf, offs = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), buf[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to


class Words:
    """Words of several texts: ``start``/``end`` byte places, ``first[d]:first[d+1]`` those of text d."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        solid = np.zeros(len(buf) + 2, bool)
        solid[1:-1] = _SOLID[buf]
        edges = np.flatnonzero(solid[1:] != solid[:-1])  # starts and ends by turns
        joints = offs[solid[offs] & solid[offs + 1]]  # texts that meet with no space between: a word ends there and one starts
        if len(joints):
            joints = joints[np.concatenate([[True], joints[1:] != joints[:-1]])]
            edges = np.insert(edges, np.repeat(np.searchsorted(edges, joints), 2), np.repeat(joints, 2))
        self.start, self.end = edges[::2].astype(np.int64), edges[1::2].astype(np.int64)
        self.first = np.searchsorted(self.start, offs)
        self.buf = buf

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, lower: bool) -> np.ndarray:
        """64-bit hash of every word, with A-Z lower-cased if asked."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        power, inverse = _powers(len(self.buf) + 1)
        values = (_LOWER_TABLE if lower else _TABLE)[self.buf]
        values *= power[: len(values)]
        sums = np.empty(len(self.buf) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(values, out=sums[1:])
        h = (sums[self.end] - sums[self.start]) * inverse[self.start]
        return mix(h + (self.end - self.start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def rolling(h: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of ``width`` consecutive values: one result per start, len(h) - width + 1 of them."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    base = (_BASE + 2 * seed) & ((1 << 64) - 1)
    out = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        out *= np.uint64(base)
        out += h[k : len(h) - width + 1 + k]
    return mix(out)
