"""Packing of token sequences into bins of fixed length by swap-based local search.

Documents are encoded and only those longer than a sequence are cut into pieces. Full pieces are
sequences by themselves. The others are dealt out by a hash into groups of about GROUP pieces, one
task each; a group starts from best fit in descending order, and then pieces are moved, exchanged one for
one, or two for one, between underfull bins, always so that the sum of squared fills grows. All exchanges of
a bin with all others are looked at. A group's search ends when it has as few bins as its tokens need, or
when PATIENCE bins in a row, the emptiest ones, cannot be emptied; the README says how near
to the least possible number that comes. Each group wastes less than one bin besides what the search
leaves, which is nothing against GROUP pieces; so groups need not know of each other.

Null and empty texts are one piece of the end id. Repeated rows are packed each for itself. An empty
table packs into nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickersieve.llm.frames import batch, chunks, documents, longs, ship, written
from tickersieve.llm.tokens import encoder

GROUP = 50_000
CHUNK = 2 << 20
PATIENCE = 64  # bins in a row that cannot be emptied before the search ends
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(docs: DataFrame, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """One row per piece of each document's ids (with the end id), and their crc32."""
    ship(docs.sparkSession)

    def step(batches) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for chunk in chunks(whole, CHUNK):
                ids, at = encoder(tokenizer).encode(chunk.column("text"))
                ids = np.insert(ids, at[1:], np.uint32(end_id)).astype("<u4")
                at = at + np.arange(len(at))
                lengths = np.diff(at)
                n = -(-lengths // size)
                row = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * size
                length = np.minimum(size, lengths[row] - start)
                raw, begin = memoryview(ids).cast("B"), (at[row] + start) * 4
                crcs = [zlib.crc32(raw[a : a + 4 * k]) for a, k in zip(begin.tolist(), length.tolist())]
                doc = chunk.column("doc_id").take(pa.array(row))
                yield batch(doc_id=doc, piece=pa.array(piece, pa.int32()), start=pa.array(start, pa.int64()), length=pa.array(length, pa.int64()), ids_crc32=pa.array(crcs, pa.int64()))

    return documents(docs).mapInArrow(step, PIECES)


class Bins:
    """Pieces in bins of one size, and where they might go."""

    def __init__(self, lengths: list[int], size: int):
        self.lengths, self.size = lengths, size
        self.items: list[list[int]] = []
        self.free: list[int] = []
        self.levels: list[list[int]] = [[] for _ in range(size + 1)]  # bins by free space; entries may be out of date
        self.mask = 0  # of the levels that have entries

    def _enter(self, b: int) -> None:
        level = self.free[b]
        if level:
            self.levels[level].append(b)
            self.mask |= 1 << level

    def best_fit(self, need: int, other_than: int = -1) -> int:
        """The fullest bin with room for `need`, or -1."""
        rest = self.mask >> need
        aside = []
        found = -1
        while rest:
            level = need + (rest & -rest).bit_length() - 1
            entries = self.levels[level]
            while entries:
                b = entries[-1]
                if self.free[b] != level or not self.items[b]:
                    entries.pop()
                elif b == other_than:
                    aside.append(entries.pop())
                else:
                    found = b
                    break
            if found >= 0:
                break
            self.mask &= ~(1 << level)
            rest = self.mask >> need
        for b in aside:
            self._enter(b)
        return found

    def put(self, item: int, b: int) -> None:
        self.items[b].append(item)
        self.free[b] -= self.lengths[item]
        self._enter(b)

    def take(self, item: int, b: int) -> None:
        self.items[b].remove(item)
        self.free[b] += self.lengths[item]
        self._enter(b)

    def fill(self) -> None:
        for item in sorted(range(len(self.lengths)), key=lambda i: (-self.lengths[i], i)):
            b = self.best_fit(self.lengths[item])
            if b < 0:
                b = len(self.items)
                self.items.append([])
                self.free.append(self.size)
            self.put(item, b)

    def search(self) -> None:
        """Empty one bin after the other, emptiest first, by moves and exchanges with underfull bins."""
        least = -(-sum(self.lengths) // self.size)
        stuck: set[int] = set()
        held = sum(bool(x) for x in self.items)
        while held > least and len(stuck) < PATIENCE:
            donors = [b for b, items in enumerate(self.items) if items and b not in stuck]
            if not donors:
                return
            donor = max(donors, key=lambda b: (self.free[b], -b))
            if self._empty(donor):
                held -= 1
            else:
                stuck.add(donor)

    def _empty(self, donor: int) -> bool:
        while self.items[donor]:
            if not (self._move(donor) or self._exchange(donor)):
                return False
        return True

    def _move(self, donor: int) -> bool:
        for item in sorted(self.items[donor], key=lambda i: -self.lengths[i]):
            b = self.best_fit(self.lengths[item], donor)
            if b >= 0 and self.free[b] - self.lengths[item] < self.free[donor]:
                self.take(item, donor)
                self.put(item, b)
                return True
        return False

    def _exchange(self, donor: int) -> bool:
        """The exchange that moves most tokens from the donor into one other underfull bin."""
        bins = [b for b, free in enumerate(self.free) if free and self.items[b] and b != donor]
        if not bins:
            return False
        item = np.array([i for b in bins for i in self.items[b]])
        place = np.repeat(bins, [len(self.items[b]) for b in bins])
        theirs = np.array(self.lengths)[item]
        room = np.array(self.free)[place]
        mine = np.array(self.items[donor])
        own = np.array(self.lengths)[mine]
        # all offers of one piece and of two, by size; an offer fits if it takes no more room than there is
        one, two = np.triu_indices(len(mine), 1)
        sums = np.concatenate([own, own[one] + own[two]])
        order = np.argsort(sums, kind="stable")
        sums = sums[order]
        fit = np.searchsorted(sums, theirs + room, "right") - 1
        gain = np.where(fit >= 0, sums[np.maximum(fit, 0)] - theirs, 0)
        # the sum of squares must grow: what the other bin then holds is more than the donor held
        gain = np.where((gain > 0) & (room - gain < self.free[donor]), gain, 0)
        k = int(gain.argmax())
        offer = int(order[fit[k]])
        chosen = (offer,) if offer < len(mine) else (int(one[offer - len(mine)]), int(two[offer - len(mine)]))
        best = (int(gain[k]), k if gain[k] > 0 else -1, [int(mine[c]) for c in chosen])
        if best[1] < 0:
            return False
        b, back = int(place[best[1]]), int(item[best[1]])
        for i in best[2]:
            self.take(i, donor)
        self.take(back, b)
        for i in best[2]:
            self.put(i, b)
        self.put(back, donor)
        return True


def pack_lengths(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of indices into `lengths`, none over `size` in sum."""
    bins = Bins(lengths, size)
    bins.fill()
    bins.search()
    return [b for b in bins.items if b]


def pack(pieces: DataFrame, size: int) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most `size` tokens; `pieces` is read twice."""
    ship(pieces.sparkSession)
    n = max(1, -(-pieces.where(F.col("length") < size).count() // GROUP))

    def step(batches) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        table = pa.Table.from_batches(tables).combine_chunks()
        lengths = longs(table.column("length").combine_chunks())
        bins = pack_lengths(lengths.tolist(), size)
        order = np.array([i for b in bins for i in b])
        sequence = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        filled = np.cumsum(lengths[order]) - lengths[order]
        first = np.append(True, sequence[1:] != sequence[:-1])
        offset = filled - np.repeat(filled[first], [len(b) for b in bins])
        number = (TaskContext.get().partitionId() + 1 << 40) + sequence
        table = table.take(pa.array(order)).append_column("sequence_id", pa.array(number, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
        yield from table.to_batches()

    # the order within a task is fixed, so that a repeated task packs the same way
    parted = pieces.where(F.col("length") < size).repartition(n, F.xxhash64("doc_id", "piece", "start", "ids_crc32")).sortWithinPartitions("doc_id", "piece", "length", "ids_crc32")
    packed = parted.mapInArrow(step, f"{PIECES}, sequence_id long, offset long")
    # numbers below 0, so apart from all others
    full = pieces.where(F.col("length") == size).withColumn("sequence_id", -F.monotonically_increasing_id() - 1).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(full)


def packed_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = 2048) -> DataFrame:
    return pack(written(cut(docs, tokenizer, end_id, size), "pieces"), size)
