"""Vectorised text kernels on the raw UTF-8 buffers of Arrow string columns (numpy only).

Words and windows of a whole batch are found and hashed at once; no Python object is made per word. All hashes are 64
bits wide and depend on the bytes alone, so they are the same in every worker and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE, _SPAN = U(0x9E3779B97F4A7C55), 1 << 17
_ODD = np.random.default_rng(20240229).integers(0, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)


def _bytes(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


#: Bytes of words that white space ends: all but blank and the five ASCII controls from tab on.
NOT_SPACE = ~_bytes((0x20, 0x20), (0x09, 0x0D))
#: Bytes of lower-cased words of letters, digits and whatever isn't ASCII.
ALNUM = _bytes((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def slices(column: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes: first and last row, their bytes, and offsets. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and where each text's words begin among them."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = kind[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, _SPAN + 1024)
            inverse = U(pow(int(_BASE), -1, 1 << 64))
            cls.up, cls.down = (np.cumprod(np.r_[U(1), np.full(size - 1, x, np.uint64)]) for x in (_BASE, inverse))
        return cls.up[:n], cls.down[:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word, from differences of one running polynomial over each span of bytes."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        zero = int(starts[at])
        end = max(at + 1, int(np.searchsorted(ends, zero + _SPAN, "right")))
        part = data[zero : int(ends[end - 1])]
        up, down = _Powers.upto(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + U(1)) * up[: len(part)], out=sums[1:])
        s, e = starts[at:end] - zero, ends[at:end] - zero
        out[at:end] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * U(0xD6E8FEB86659FD93)
        at = end
    return mix(out)


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k words in a row; those that cross two texts are for the caller to leave out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n] * _ODD[0]
    for j in range(1, k):
        out += hashes[j : j + n] * _ODD[j]
    return mix(out + U(k))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5, kind: np.ndarray = NOT_SPACE, low: bool = True) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its k-word shingles; a text of fewer words has its whole sequence."""
    if low:
        data = LOWER[data]
    starts, ends, bounds = words(data, offsets, kind)
    hashes = word_hashes(data, starts, ends)
    full = window_hashes(hashes, k)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if hi - lo >= k:
            out.append(np.unique(full[lo : hi - k + 1]))
        else:
            out.append(window_hashes(hashes[lo:hi], hi - lo) if hi > lo else full[:0])
    return out


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie in a window of the given length that begins at one of ``starts``."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + length, n), -1)
    return np.cumsum(steps[:-1]) > 0
