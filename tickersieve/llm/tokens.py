"""Token ids of whole texts by a public tokenizer, many texts at once.

The `tokenizers` library encodes. For the two kinds of vocabulary whose text pieces are known to be
encoded each by itself (byte-level pieces, and lower-case words), texts in plain Latin letters are cut
into pieces with numpy, and the library encodes each distinct piece once per worker instead of every
time; all other texts, and all other tokenizers, go through the library whole.
"""

from __future__ import annotations

import json
import os
from functools import cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import pandas as pd
import pyarrow as pa
from tokenizers import Tokenizer

from tickersieve.llm.frames import bytes_of
from tickersieve.llm.words import hash_spans

SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
REMEMBERED = 1_500_000  # pieces a worker remembers before it starts anew; never changes a result

_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[0x20, 0x09, 0x0A, 0x0D]] = SPACE
_CLASS[ord("0") : ord("9") + 1] = DIGIT
_CLASS[ord("A") : ord("Z") + 1] = LETTER
_CLASS[ord("a") : ord("z") + 1] = LETTER
_CLASS[0x80:] = LETTER
# Not plain: control characters, apostrophes (contractions), and code points outside U+00C0 to U+027F.
_ODD = np.zeros(256, bool)
_ODD[:0x20] = True
_ODD[[0x09, 0x0A, 0x0D]] = False
_ODD[[0x27, 0x7F, 0xC0, 0xC1, 0xC2]] = True
_ODD[0xCA:] = True


def _not_plain(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text: must the library see it whole?"""
    odd = _ODD[data]
    for first, second in ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0), (0x3C, 0x7C)):  # signs × and ÷, dotted capital I, "<|"
        hit = np.flatnonzero(data[:-1] == first)
        odd[hit[data[hit + 1] == second]] = True
    sums = np.concatenate([[0], np.cumsum(odd)])
    return sums[offsets[1:]] > sums[offsets[:-1]]


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each byte, whether a run of one class starts there, and where texts start."""
    kind = _CLASS[data]
    start = np.ones(len(data), bool)
    start[1:] = kind[1:] != kind[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[heads] = True
    return kind, start, heads


def byte_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of letters, digits or other signs, each with one blank before it; the rest of white space."""
    kind, start, heads = _runs(data, offsets)
    after = start.copy()
    after[heads] = False
    after &= kind != SPACE
    after[1:] &= kind[:-1] == SPACE
    after[0] = False
    at = np.flatnonzero(after)
    start[at - 1] = True
    start[at[data[at - 1] == 0x20]] = False
    starts = np.flatnonzero(start)
    return starts, np.append(starts[1:], len(data))


def word_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of letters or other signs, and single digits, without white space."""
    kind, start, _ = _runs(data, offsets)
    start |= kind == DIGIT
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], len(data))
    use = kind[starts] != SPACE
    return starts[use], ends[use]


def _cutter(config: dict):
    pre, norm = config.get("pre_tokenizer") or {}, config.get("normalizer")
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
        return byte_pieces
    words = {"'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}
    steps = pre.get("pretokenizers", [])
    if norm and [n.get("type") for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and len(steps) == 2 and steps[0].get("pattern", {}).get("Regex") in words and steps[0].get("invert"):
        return word_pieces
    return None


class Encoder:
    """Encodes texts to ids without special tokens; equal to the library's encode_batch."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.cut = _cutter(json.load(file))
        self._forget()

    @property
    def size(self) -> int:
        return self.library.get_vocab_size(with_added_tokens=True)

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slots = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int32)
        self.begins = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _remember(self, keys: np.ndarray, texts: list[str]) -> None:
        coded = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, coded), np.int32, len(coded))
        ids = np.fromiter((i for c in coded for i in c), np.uint32, int(lengths.sum()))
        slots = np.arange(len(self.lengths), len(self.lengths) + len(keys))
        self.begins = np.concatenate([self.begins, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, ids])
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.slots = np.insert(self.slots, place, slots)

    def _slots(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each piece the number of its distinct piece, and for each of these its slot."""
        code, unique = pd.factorize(hash_spans(data, starts, ends))
        example = np.zeros(len(unique), np.int64)
        example[code[::-1]] = np.arange(len(code))[::-1]
        if len(self.keys) + len(unique) > REMEMBERED:
            self._forget()
        order = np.argsort(unique)
        keys = unique[order]
        place = np.searchsorted(self.keys, keys)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == keys[known]
        fresh = order[~known]
        if len(fresh):
            view = data.tobytes()
            a, b = starts[example[fresh]].tolist(), ends[example[fresh]].tolist()
            self._remember(keys[~known], [view[i:j].decode() for i, j in zip(a, b)])
            place = np.searchsorted(self.keys, keys)
        slots = np.zeros(len(unique), np.int64)
        slots[order] = self.slots[place]
        return code, slots

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: none) end to end, and the offsets of each text's."""
        data, offsets = bytes_of(texts)
        n = len(offsets) - 1
        whole = np.ones(n, bool) if self.cut is None else _not_plain(data, offsets) if len(data) else np.zeros(n, bool)
        if not whole.any():
            return self._plain(data, offsets)
        # cut the plain texts together, then put each text's ids in its place
        plain = np.flatnonzero(~whole)
        part = texts.take(pa.array(plain))
        ids, at = self._plain(*bytes_of(part)) if len(plain) else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
        rest = np.flatnonzero(whole)
        coded = self.library.encode_batch_fast([texts[int(i)].as_py() or "" for i in rest], add_special_tokens=False)
        pieces: list[np.ndarray] = [None] * n
        for k, i in enumerate(plain):
            pieces[i] = ids[at[k] : at[k + 1]]
        for i, c in zip(rest, coded):
            pieces[i] = np.array(c.ids, np.uint32)
        return np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(p) for p in pieces])])

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts, ends = self.cut(data, offsets)
        code, slots = self._slots(data, starts, ends)
        lengths = self.lengths[slots][code].astype(np.int64)
        sums = np.concatenate([[0], np.cumsum(lengths)])
        index = np.repeat(self.begins[slots][code] - sums[:-1], lengths)
        index += np.arange(sums[-1])
        return self.ids[index], sums[np.searchsorted(starts, offsets)]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)
