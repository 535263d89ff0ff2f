"""Words of whole texts and their hashes, for many texts at once (numpy inside tasks)."""

from __future__ import annotations

import hashlib

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)  # fixed values of a public 64-bit mixer
_S = np.uint64(33)
_LONG_WORD = 4096
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    h = h ^ (h >> _S)
    h *= _M1
    h ^= h >> _S
    h *= _M2
    h ^= h >> _S
    return h


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word `[^\\x20\\x09-\\x0D]+`, and each text's first word (one more at the end)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~SPACE[data]
    starts_here = inside[1:] & ~inside[:-1]
    ends_here = inside[:-1] & ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    starts_here[cuts] = inside[cuts + 1]
    ends_here[cuts] = inside[cuts]
    starts, ends = np.flatnonzero(starts_here), np.flatnonzero(ends_here)
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    lengths = ends - starts
    h = mix(lengths.astype(np.uint64) + np.uint64(1))
    at, left, which = starts, lengths, None
    for _ in range(_LONG_WORD // 8):
        block = eight[at]
        short = np.maximum(8 - left, 0).astype(np.uint64) * np.uint64(8)
        np.minimum(short, np.uint64(63), out=short)
        block = (block << short) >> short
        if which is None:
            h = mix(h ^ (block + BASE))
        else:
            h[which] = mix(h[which] ^ (block + BASE))
        more = np.flatnonzero(left > 8)
        if not len(more):
            return h
        which = more if which is None else which[more]
        at, left = at[more] + 8, left[more] - 8
    for i in which:
        h[i] = np.frombuffer(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), np.uint64)[0]
    return h


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out) if n else out


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each `size` consecutive words; one for each start that has as many words after it."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if size <= 8:
        h = np.zeros(n, np.uint64)
        for i in range(size):
            h = h * BASE + words[i : i + n]
        return mix(h)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(BASE, len(words)), out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * powers(BASE_INVERSE, n))


def inside_one(first: np.ndarray, size: int, total: int) -> np.ndarray:
    """For each start of a window over texts laid end to end: is it within one text?"""
    n = total - size + 1
    good = np.ones(max(n, 0), bool)
    for cut in first[1:-1]:  # windows that would cross into the next text
        good[max(0, cut - size + 1) : min(cut, n)] = False
    return good
