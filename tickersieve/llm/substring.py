"""Exact removal of long repeats across documents by seed and extend.

Seeds are winnowed anchors: of every WINDOW consecutive words, i.e. of the hashes of all its ANCHOR-word
runs, the smallest (the last of equal ones) is selected. So equal windows select the same anchor at
the same place, and each window belongs to one anchor; consecutive windows with one anchor form a segment.

1. Documents are joined on anchors. Anchors of a single document end here.
2. Where all occurrences of an anchor extend to the same segment, the extension is known from one hash
   of the segment: every later document's segment is a repeat of the first document's.
3. Where they extend differently, each distinct segment is kept in its first document only (later
   ones are repeats as before), and these are extended to the left and right word by word: for each
   number of words to the left, the matching words to the right are fixed, so that a hash of the window finds
   the first document with the same extension. Groups of copies never give pairs.
4. Overlapping matches of a document merge into maximal repeats; their words are removed.

Hashes are 64 bits wide and compared only within the same anchor's 64 bits.

A null or empty text has no words; one of fewer than WINDOW words loses none. Rows of one doc_id don't
remove each other's words (their id isn't smaller); each repeated row has its own result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickersieve.llm.frames import batch, bytes_of, documents, dropped, longs, map_arrow, written
from tickersieve.llm.words import hash_spans, inside_one, mix, spans, window_hashes

WINDOW = 50
ANCHOR = 10
HOT = 0.001
SLICE = 1 << 21  # windows looked at in one step; positions within it fit the low bits of a sort key
_LOW = np.uint64((1 << 22) - 1)

ANCHORS = "h long, segment long, doc_id long, text_key int, first int, n int"


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each `size` consecutive numbers, by doubling."""
    have = 1
    while have * 2 <= size:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (size - have)], x[size - have :]) if have < size else x


def _hashes(chunk: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts end to end, and each text's first word."""
    data, offsets = bytes_of(chunk.column("text"))
    starts, ends, first = spans(data, offsets)
    return hash_spans(data, starts, ends), first


def _anchors(chunk: pa.RecordBatch, window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    words, first = _hashes(chunk)
    total = len(words) - window + 1
    if total <= 0:
        return
    valid = inside_one(first, window, len(words))
    doc_ids, keys = longs(chunk.column("doc_id")), longs(chunk.column("text_key"))
    for a in range(0, total, SLICE):
        b = min(a + SLICE, total)
        part = words[a : b + window - 1]
        grams = window_hashes(part, anchor)
        whole = window_hashes(part, window)
        place = np.arange(len(grams), dtype=np.uint64)
        chosen = _sliding_min((grams & ~_LOW) | (_LOW - place), window - anchor + 1)
        chosen = (_LOW - (chosen & _LOW)).astype(np.int64)
        good = valid[a:b]
        new = good.copy()
        new[1:] &= (chosen[1:] != chosen[:-1]) | ~good[:-1]
        begin = np.flatnonzero(new)
        if not len(begin):
            continue
        stop = np.zeros(len(good), bool)  # last window of its segment
        stop[:-1] = good[:-1] & (~good[1:] | new[1:])
        stop[-1] = good[-1]
        last = np.flatnonzero(stop)
        n = last - begin + 1
        doc = np.searchsorted(first, a + begin, "right") - 1
        yield batch(
            h=pa.array(grams[chosen[begin]].view(np.int64)),
            segment=pa.array(mix(mix(whole[begin] + n.astype(np.uint64)) ^ whole[last]).view(np.int64)),
            doc_id=pa.array(doc_ids[doc]), text_key=pa.array(keys[doc], pa.int32()),
            first=pa.array(a + begin - first[doc], pa.int32()), n=pa.array(n, pa.int32()),
        )


def _ragged(column: pa.Array) -> tuple[pa.StructArray, np.ndarray]:
    """The structs of a list column end to end, and how many each row has."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten(), sizes


def _extended(chunk: pa.RecordBatch, window: int) -> Iterator[pa.RecordBatch]:
    """The hash of every window of the given segments."""
    words, first = _hashes(chunk)
    found, sizes = _ragged(chunk.column("segments"))
    if not len(found):
        return
    row = np.repeat(np.arange(chunk.num_rows), sizes)
    begin, n, h = (longs(found.field(k)) for k in ("first", "n", "h"))
    which = np.repeat(np.arange(len(begin)), n)
    at = begin[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    whole = window_hashes(words, window)[first[row[which]] + at]
    doc_ids, keys = longs(chunk.column("doc_id")), longs(chunk.column("text_key"))
    yield batch(h=pa.array(h[which]), w=pa.array(whole.view(np.int64)), doc_id=pa.array(doc_ids[row[which]]), text_key=pa.array(keys[row[which]], pa.int32()), first=pa.array(at, pa.int32()))


def matches(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, text_key, first, n: `n` windows from word `first` on that a smaller doc_id also holds."""
    texts = _keyed(docs)
    found = written(map_arrow(texts, _anchors, ANCHORS, window=window, anchor=anchor), "anchors")
    shared = found.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min("segment").alias("s0"), F.max("segment").alias("s1"), F.count("*").alias("of"))
    shared = written(shared.where("low < high").select("h", "low", (F.col("s0") == F.col("s1")).alias("alike"), "of"), "shared")
    # anchors with more than a share HOT of all rows, so less than 1 / HOT of them, are joined without a shuffle
    hot = F.col("of") > found.count() * HOT
    often = F.broadcast(shared.where(hot).drop("of"))
    seeds = found.join(often, "h").unionByName(found.join(often.select("h"), "h", "left_anti").join(shared.where(~hot).drop("of"), "h"))
    seeds = written(seeds.where("not alike or doc_id > low"), "seeds")
    dropped(found, shared)
    differ = seeds.where("not alike").drop("low", "alike")
    first_of = differ.groupBy("h", "segment").agg(F.min("doc_id").alias("low"))
    differ = written(differ.join(first_of, ["h", "segment"]), "differ")
    # the first document of each distinct segment takes part in the word-by-word extension
    lists = differ.where("doc_id = low").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first", "n", "h")).alias("segments"))
    windows = written(map_arrow(texts.join(lists, ["doc_id", "text_key"]), _extended, "h long, w long, doc_id long, text_key int, first int", window=window), "windows")
    repeated = windows.groupBy("h", "w").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("h", "w", "low")
    columns = ["doc_id", "text_key", "first", "n"]
    inner = windows.join(repeated, ["h", "w"]).where("doc_id > low").withColumn("n", F.lit(1)).select(columns)
    same = seeds.where("alike").select(columns)
    later = differ.where("doc_id > low").select(columns)
    return same.unionByName(later).unionByName(inner)


def _keyed(docs: DataFrame) -> DataFrame:
    """With text_key, which tells apart different texts under one doc_id."""
    return documents(docs).withColumn("text_key", F.hash("text"))


def maximal(begin: np.ndarray, n: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Disjoint word ranges, in order, that the matched windows cover."""
    order = np.argsort(begin, kind="stable")
    begin, stop = begin[order], np.maximum.accumulate((begin + n + window - 1)[order])
    heads = np.flatnonzero(np.append(True, begin[1:] > stop[:-1]))
    return list(zip(begin[heads].tolist(), stop[np.append(heads[1:], len(begin)) - 1].tolist()))


def _cleaned(chunk: pa.RecordBatch, window: int) -> Iterator[pa.RecordBatch]:
    found, sizes = _ragged(chunk.column("repeats"))
    begin, n = (longs(found.field(k)) for k in ("first", "n"))
    at = np.concatenate([[0], np.cumsum(sizes)])
    total, removed, kept, ranges = [], [], [], []
    for i, text in enumerate(chunk.column("text").to_pylist()):
        words = (text or "").encode().split()
        gone = maximal(begin[at[i] : at[i + 1]], n[at[i] : at[i + 1]], window) if sizes[i] else []
        total.append(len(words))
        removed.append(sum(b - a for a, b in gone))
        for a, b in reversed(gone):
            del words[a:b]
        kept.append(b" ".join(words).decode())
        ranges.append(gone)
    yield batch(
        doc_id=chunk.column("doc_id"), n_words=pa.array(total, pa.int64()), n_removed=pa.array(removed, pa.int64()), kept=pa.array(kept, pa.string()),
        repeats=pa.array([[{"first": a, "stop": b} for a, b in r] for r in ranges], pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32())]))),
    )


def _digest(chunk: pa.RecordBatch, window: int) -> Iterator[pa.RecordBatch]:
    for out in _cleaned(chunk, window):
        shas = [hashlib.sha256(t.encode()).hexdigest() for t in out.column("kept").to_pylist()]
        yield batch(doc_id=out.column("doc_id"), n_words=out.column("n_words"), n_removed=out.column("n_removed"), kept_sha256=pa.array(shas, pa.string()))


def _with_repeats(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    lists = matches(docs, window, anchor).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first", "n")).alias("repeats"))
    return _keyed(docs).join(lists, ["doc_id", "text_key"], "left").select("doc_id", "text", "repeats")


def deduplicated(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept words joined by blanks, and the maximal repeats removed."""
    return map_arrow(_with_repeats(docs, window, anchor), _cleaned, "doc_id long, n_words long, n_removed long, kept string, repeats array<struct<first: int, stop: int>>", window=window)


def digests(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """As `deduplicated`, with the sha256 of the kept text in its place."""
    return map_arrow(_with_repeats(docs, window, anchor), _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string", window=window)
