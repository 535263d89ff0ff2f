"""Benchmark decontamination by rare seeds and local alignment.

A passage around each group of seed hits in a document is aligned with a test item by Smith-Waterman on
words (match 1, mismatch and gap -1). A document is contaminated by an item if the best alignment scores at
least THRESHOLD of the item's number of words.

Seeds are pairs of neighbouring words of an item. An alignment of score s has e mismatches and gaps and s + e
matches, in at most e + 1 runs, so it holds s - 1 pairs of the item at least. Of the pairs of an item that
must score s, all but the s - 2 most frequent in the corpus are kept; so each contaminating passage has a hit.

Items are taken in blocks of at most BLOCK_BYTES of text, each against all documents; only a block is
sent to the tasks. Words are runs of letters and digits in lower case. Items of one word or none have no pair and match nothing;
one of two words matches only where both stand together; a null
or empty text is clean. Repeated rows repeat their result. Ties go to the smallest item_id.
Items and texts may have any length: scores are 32-bit numbers, and an alignment takes as many steps as item and passage have
words multiplied, in memory of a few rows of the passage's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickersieve.llm.frames import batch, bytes_of, chunks, map_arrow, ship, written
from tickersieve.llm.words import hash_spans, inside_one, spans, window_hashes

SEED = 2
THRESHOLD = 0.5
BLOCK_BYTES = 4 << 20
CELLS = 2 << 20  # of alignment tables worked on at once

_KEPT = np.full(256, 0x20, np.uint8)
for _low, _high in (("a", "z"), ("0", "9")):
    _KEPT[ord(_low) : ord(_high) + 1] = np.arange(ord(_low), ord(_high) + 1)
_KEPT[0x80:] = np.arange(0x80, 0x100)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts end to end, and each text's first word (one more at the end)."""
    data, offsets = bytes_of(pc.utf8_lower(texts.fill_null("")))
    data = _KEPT[data]
    starts, ends, first = spans(data, offsets)
    return hash_spans(data, starts, ends), first


@dataclass
class Items:
    """A block of test items: words end to end, and seeds with where they occur."""

    ids: np.ndarray
    words: np.ndarray
    first: np.ndarray
    seeds: np.ndarray  # sorted; repeated if several places share one
    item: np.ndarray
    place: np.ndarray


def _grams(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the SEED words from each word on that has so many after it in its text, and where."""
    grams = window_hashes(words, SEED)
    at = np.flatnonzero(inside_one(first, SEED, len(words)))
    return grams[at] if len(at) else np.zeros(0, np.uint64), at


def _items(rows: list[tuple[int, str]]) -> Items:
    words, first = words_of(pa.array([r[1] for r in rows], pa.string()))
    grams, at = _grams(words, first)
    item = np.searchsorted(first, at, "right") - 1
    order = np.argsort(grams, kind="stable")
    return Items(np.array([r[0] for r in rows]), words, first, grams[order], item[order], (at - first[item])[order])


def _rarest(items: Items, counts: dict[int, int]) -> Items:
    """Leaves out as many of each item's most frequent seeds as any contaminating alignment can spare."""
    often = np.array([counts.get(int(s), 0) for s in items.seeds.view(np.int64)], np.int64)
    order = np.lexsort((items.place, often, items.item))
    sizes = np.bincount(items.item, minlength=len(items.ids))
    rank = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    spared = np.maximum(0, np.ceil(THRESHOLD * np.diff(items.first)).astype(np.int64) - 2)
    keep = np.sort(order[rank < np.repeat(sizes - spared, sizes)])
    return Items(items.ids, items.words, items.first, items.seeds[keep], items.item[keep], items.place[keep])


def _hits(grams: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a place in `grams` and a place in the sorted `seeds` that are equal."""
    low, high = np.searchsorted(seeds, grams, "left"), np.searchsorted(seeds, grams, "right")
    n = high - low
    which = np.repeat(np.arange(len(grams)), n)
    return which, low[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


def _counter(items: Items):
    distinct = np.unique(items.seeds)

    def count(batches) -> Iterator[pa.RecordBatch]:
        tally = np.zeros(len(distinct) + 1, np.int64)
        for whole in batches:
            for chunk in chunks(whole):
                grams, _ = _grams(*words_of(chunk.column("text")))
                place = np.minimum(np.searchsorted(distinct, grams), max(0, len(distinct) - 1))
                if len(distinct):
                    tally += np.bincount(place[distinct[place] == grams], minlength=len(distinct) + 1)
        used = np.flatnonzero(tally[:-1])
        yield batch(seed=pa.array(distinct[used].view(np.int64)), n=pa.array(tally[used]))

    return count


def align(passage: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Best local alignment score of each row of `passage` with the same row of `item` (0: no word)."""
    width = passage.shape[1]
    best = np.zeros(len(passage), np.int32)
    above = np.zeros((len(passage), width + 1), np.int32)
    slope = np.arange(width + 1, dtype=np.int32)
    for i in range(item.shape[1]):
        word = item[:, i : i + 1]
        score = np.where((passage == word) & (word != 0), 1, -1).astype(np.int32)
        now = np.zeros_like(above)
        np.maximum(above[:, :-1] + score, above[:, 1:] - 1, out=now[:, 1:])
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + slope, axis=1) - slope  # gaps to the left
        above = now
        np.maximum(best, now.max(1), out=best)
    return best


def _matches(texts: pa.Array, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, item and score of each item that has a seed in a text."""
    words, first = words_of(texts)
    grams, at = _grams(words, first)
    which, seed = _hits(grams, items.seeds)
    if not len(which):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(float)
    doc = np.searchsorted(first, at[which], "right") - 1
    item = items.item[seed]
    size = np.diff(items.first)
    begin = at[which] - items.place[seed]  # where the item would start
    order = np.lexsort((begin, item, doc))
    doc, item, begin = doc[order], item[order], begin[order]
    # hits of one item whose passages would overlap are one passage
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > size[item[1:]] // 2)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(new)) - 1
    doc, item = doc[heads], item[heads]
    margin = size[item] // 2 + 2
    low = np.maximum(begin[heads] - margin, first[doc])
    high = np.minimum(begin[tails] + size[item] + margin, first[doc + 1])
    # long chains of hits are cut into passages of three items' length that overlap by half
    step, span = -(-3 * size[item] // 2), 3 * size[item] + 4
    n = np.maximum(1, -(-(high - low - span) // step) + 1)
    part = np.repeat(np.arange(len(doc)), n)
    low = low[part] + (np.arange(len(part)) - np.repeat(np.cumsum(n) - n, n)) * step[part]
    high = np.minimum(high[part], low + span[part])
    doc, item = doc[part], item[part]
    score = np.zeros(len(doc))
    by_size = np.lexsort((high - low, size[item]))
    shown = np.where(words == 0, np.uint64(1), words)
    theirs = np.where(items.words == 0, np.uint64(1), items.words)
    k = 0
    while k < len(by_size):
        width = int((high - low)[by_size[k:]].max()) if len(by_size) - k < 64 else int((high - low).max())
        rows = by_size[k : k + max(1, CELLS // max(1, width))]
        k += len(rows)
        width, depth = int((high - low)[rows].max()), int(size[item[rows]].max())
        index = low[rows][:, None] + np.arange(width)
        passage = np.where(index < high[rows][:, None], shown[np.minimum(index, len(words) - 1)], np.uint64(2))
        index = items.first[item[rows]][:, None] + np.arange(depth)
        target = np.where(np.arange(depth) < size[item[rows]][:, None], theirs[np.minimum(index, len(theirs) - 1)], np.uint64(0))
        score[rows] = align(passage, target) / size[item[rows]]
    return doc, item, score


def _step(chunk: pa.RecordBatch, items: Items) -> Iterator[pa.RecordBatch]:
    doc, item, score = _matches(chunk.column("text"), items)
    n = chunk.num_rows
    hit = score >= THRESHOLD
    count = np.zeros(n, np.int64)
    if hit.any():
        pairs = np.unique(np.stack([doc[hit], item[hit]]), axis=1)
        count = np.bincount(pairs[0], minlength=n)
    best = np.full(n, -1)
    order = np.lexsort((items.ids[item], -score))[::-1]
    best[doc[order]] = order  # the last to be set is the best
    found = best >= 0
    scores = np.where(found, score[best] if len(score) else 0.0, 0.0)
    names = pa.array([int(items.ids[item[b]]) if f and s >= THRESHOLD else None for b, f, s in zip(best, found, scores)], pa.int64())
    kept = {c: chunk.column(c) for c in chunk.schema.names}
    yield batch(**kept, n_items=pa.array(count, pa.int64()), item_id=names, score=pa.array(scores, pa.float64()))


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    held, size = [], 0
    for item, text in rows.orderBy("item_id", "text").toLocalIterator():
        if held and size + len(text) > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append((item, text))
        size += len(text)
    if held:
        yield held


def scored(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All columns of the input with n_items (that contaminate it), item_id and score of the best
    alignment (item_id only if it contaminates); these replace columns of the same names."""
    new = ("n_items", "item_id", "score")
    docs = docs.drop(*new).withColumn("text", F.col("text").cast("string"))
    ship(docs.sparkSession)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "n_items long", "item_id long", "score double"])
    out = None
    for rows in _blocks(benchmark):
        items = _items(rows)
        # at most one row for each seed of the block comes to the driver
        counts = docs.select("text").mapInArrow(_counter(items), "seed long, n long").groupBy("seed").agg(F.sum("n")).collect()
        items = _rarest(items, dict(map(tuple, counts)))
        if out is None:
            out = map_arrow(docs, _step, schema, items=items)
            continue
        before = written(out, "scored").withColumnsRenamed({c: f"{c}_before" for c in new})
        out = map_arrow(before, _step, ", ".join([schema.rsplit(", ", 3)[0], "n_items_before long, item_id_before long, score_before double", *schema.rsplit(", ", 3)[1:]]), items=items)
        better = F.col("score") > F.col("score_before")
        out = out.select(*docs.columns, (F.col("n_items") + F.col("n_items_before")).alias("n_items"), F.when(better, F.col("item_id")).otherwise(F.col("item_id_before")).alias("item_id"), F.greatest("score", "score_before").alias("score"))
    if out is None:
        return docs.withColumns({"n_items": F.lit(0).cast("long"), "item_id": F.lit(None).cast("long"), "score": F.lit(0.0)})
    return out
