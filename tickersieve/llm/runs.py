"""Runs of letters of whole texts, for many texts at once, and the distinct ones with their counts."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

# The remainders of the public CRC-32 for each byte, from its polynomial.
_REST = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _REST = np.where(_REST & np.uint32(1), (_REST >> np.uint32(1)) ^ np.uint32(0xEDB88320), _REST >> np.uint32(1)).astype(np.uint32)
_SHORT = 64  # bytes; longer runs are few and go one by one


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of true bytes within one text, and each text's first run (one more at the end)."""
    padded = np.zeros(len(inside) + 2, bool)
    padded[1:-1] = inside
    begins, stops = padded[1:] & ~padded[:-1], padded[:-1] & ~padded[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(inside))]
    begins[cuts] = padded[cuts + 1]
    stops[cuts] = padded[cuts]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops), np.searchsorted(starts, offsets)


def texts_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.StringArray:
    """The spans, which are in order and don't overlap, as an array of texts."""
    change = np.zeros(len(data) + 1, np.int8)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    values = data[np.cumsum(change[:-1], dtype=np.int8).astype(bool)]
    at = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=at[1:])
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(at.tobytes()), pa.py_buffer(values.tobytes()))


def code_points(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    return before[ends] - before[starts]


def crc32s(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The unsigned crc32 of each span's bytes, continuing the crc32 `before` it."""
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    at, left = starts[order], sizes[order]
    state = before[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    long_ = int(np.searchsorted(-left, -_SHORT, "left"))  # of more than _SHORT bytes
    active = np.searchsorted(-left, -np.arange(1, _SHORT + 1), "right")
    for i in range(_SHORT):
        a = int(active[i])
        if a <= long_:
            break
        part = state[long_:a]
        state[long_:a] = _REST[(part ^ data[at[long_:a] + i]) & np.uint32(0xFF)] ^ (part >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for i in range(long_):
        state[i] = zlib.crc32(data[at[i] : at[i] + left[i]].tobytes(), int(before[order[i]]))
    out = np.empty_like(state)
    out[order] = state
    return out
