"""Kernels on the UTF-8 buffers of Arrow strings: no Python object is made per word or shingle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_OFFSET, _FACTOR, _BLANK = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3), 0x20


def pieces(texts: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes, or one longer text: first and last row, bytes, and offsets into them.
    Null is empty."""
    column = texts.cast(pa.large_string()).fill_null("")
    size = len(column)
    if not size:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + size + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < size:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def fnv1a(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit FNV-1a of each span of bytes: all spans advance together, the longest first, so the rest drop out in turn."""
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    at, sizes = starts[order].copy(), sizes[order]
    h = np.full(len(order), _OFFSET, np.uint64)
    longest = int(sizes[0]) if len(sizes) else 0
    left = np.searchsorted(-sizes, -np.arange(longest), "left")
    for n in left.tolist():
        h[:n] = (h[:n] ^ data[at[:n]]) * _FACTOR
        at[:n] += 1
    out = np.empty(len(order), np.uint64)
    out[order] = h
    return out


def shingle_spans(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each k words in a row of texts whose words are divided by single blanks, and their number by
    text. A text of fewer words has one span, the whole; an empty one none."""
    inside = data != _BLANK
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    bounds = np.searchsorted(starts, offsets)
    words = np.diff(bounds)
    sizes = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    text = np.repeat(np.arange(len(sizes)), sizes)
    head = bounds[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    tail = np.minimum(head + k, bounds[1:][text]) - 1
    return starts[head], ends[tail], sizes


def spaced(data: np.ndarray, offsets: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of texts whose runs of bytes that aren't ``kept`` (a flag for each of 256) are one blank between
    kept ones, and nothing at a text's ends. The combining marks U+0300 to U+036F go without a blank."""
    if data.max(initial=0) >= 0x80:
        after = np.append(data[1:], np.uint8(0))
        mark = (data == 0xCC) | ((data == 0xCD) & (after <= 0xAF))
        mark[1:] |= mark[:-1].copy()
        offsets = np.append(0, np.cumsum(~mark))[offsets]
        data = data[~mark]
    inside = kept[data]
    at = np.flatnonzero(inside)
    bounds = np.searchsorted(at, offsets)
    blank = np.append(False, np.diff(at) > 1)[: len(at)]
    blank[bounds[:-1][bounds[:-1] < len(at)]] = False  # before a text's first byte
    place = np.arange(len(at)) + np.cumsum(blank)
    out = np.full(len(at) + int(blank.sum()), _BLANK, np.uint8)
    out[place] = data[at]
    return out, bounds + np.append(0, np.cumsum(blank))[bounds]
