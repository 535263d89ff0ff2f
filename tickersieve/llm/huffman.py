"""Length-limited canonical Huffman codes over ids: code building, encoding, table-driven decoding."""

from __future__ import annotations

import numpy as np

LIMIT = 18  # bits of the longest code, and so of the decoding table's index
MARK_EVERY = 128  # ids between two bit-offset checkpoints


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code length of each id under the limit (0: the id doesn't occur), by package-merge."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n > 1 << limit:
        raise ValueError(f"{n} ids do not fit codes of {limit} bits")
    if n < 2:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    items, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        rank = np.argsort(both, kind="stable")
        items = both[rank]
        is_leaf.append(rank < n)
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for flags in reversed(is_leaf):
        chosen = int(flags[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    out[order] = lengths
    return out


def codes(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each id: by length, then id."""
    out = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    widths = lengths[order].astype(np.uint64)
    if len(order):
        top = np.uint64(int(widths.max()))
        room = np.uint64(1) << (top - widths)
        out[order] = (np.cumsum(room) - room) >> (top - widths)
    return out


def encode(ids: np.ndarray, lengths: np.ndarray, code: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit stream (first bit highest) and the bit offset of every MARK_EVERY-th id."""
    if not len(ids):
        return b"", np.zeros(0, np.uint32)
    width = lengths[ids].astype(np.int64)
    end = np.cumsum(width)
    begin = end - width
    value = code[ids]
    word = begin >> 6
    spare = 64 - (begin & 63) - width
    inside = value << np.maximum(spare, 0).astype(np.uint64)
    over = np.flatnonzero(spare < 0)
    inside[over] = value[over] >> (-spare[over]).astype(np.uint64)
    sums = np.cumsum(inside)  # bits of one word don't overlap, so its codes add up; wraps around freely
    last = np.append(np.flatnonzero(word[1:] != word[:-1]), len(ids) - 1)
    words = np.zeros(int(word[-1]) + 2, np.uint64)
    words[: len(last)] = np.diff(sums[last], prepend=np.uint64(0))
    words[word[over] + 1] += value[over] << (64 + spare[over]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: (int(end[-1]) + 7) // 8], begin[::MARK_EVERY].astype(np.uint32)


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """For each possible next `bits` bits: id and code length, packed as id * 32 + length."""
    bits = int(lengths.max(initial=1))
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    table = np.zeros(1 << bits, np.uint32)
    filled = np.repeat(order.astype(np.uint32) * np.uint32(32) + lengths[order], 1 << (bits - lengths[order].astype(np.int64)))
    table[: len(filled)] = filled
    return table, bits


def decode(stream: np.ndarray, marks: np.ndarray, counts: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """All ids after the given bit offsets, `counts` ids each, every offset on its own side by side."""
    padded = np.zeros(len(stream) + 4, np.uint8)
    padded[: len(stream)] = stream
    four = np.ndarray((len(stream) + 1,), ">u4", padded, strides=(1,))
    steps = int(counts.max(initial=0))
    out = np.zeros((steps, len(marks)), np.uint32)
    order = np.argsort(-counts, kind="stable")
    at = marks[order].astype(np.int64)
    alive = len(order) - np.searchsorted(counts[order][::-1], np.arange(steps), "right")
    top = 32 - bits
    mask = np.uint32((1 << bits) - 1)
    for step in range(steps):
        k = alive[step]
        here = at[:k]
        window = four[here >> 3].astype(np.uint32)
        window >>= (top - (here & 7)).astype(np.uint32)
        window &= mask
        found = table[window]
        out[step, :k] = found >> np.uint32(5)
        at[:k] += found & np.uint32(31)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    lanes = out.T[back]
    return lanes[np.arange(steps) < counts[:, None]]
