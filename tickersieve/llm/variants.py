"""Grouping of spelling variants with a bit-sliced position index.

Words are the letter runs of all texts, thinned by a rule (see `run_counts`), of at least SHORTEST code points and FEWEST
occurrences. Two words are near if exactly one inserted, deleted or replaced code point makes one the other.

Near words of m and m or m + 1 code points have their first or their last m // 2 code points in common, so
the vocabulary is dealt into buckets of these (each word is in four at most), and every near pair is in one
bucket of its beginning, or else in one of its end. In a bucket of the index, the words are bits of numbers, one
number for each (position, letter). A query walks along its letters and keeps the set of words that have matched so far
without error, and those with one replaced, one missing or one additional letter, whose positions are
shifted by one; a step takes a few operations on whole numbers, for all words of the bucket at once.

Buckets of more than BLOCK words are cut into blocks, and every block of queries meets every block of the index in a
task's row group of its own, so that no bucket is ever whole in one task. Counts and best neighbours of a word combine
before they are shuffled. A word has no more neighbours than its length and the alphabet allow, and no list of pairs is made.

A null or empty text has no words. A null doc_id stands for an empty text in the rule of `run_counts`. Repeated rows count
each time. An empty table gives an empty result. Other columns don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickersieve.llm.frames import batch, bytes_of, dropped, map_arrow, ship, written
from tickersieve.llm.runs import code_points, crc32s, runs, texts_of
from tickersieve.llm.words import LOWER

SHORTEST = 5  # code points
FEWEST = 3  # occurrences
RATIO = 2  # a form occurs so many times as often
DROPPED = 97  # of so many runs one loses a code point
BLOCK = 4096

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[0xC3] = True  # begins each of the letters from U+00C0 to U+00FF


def run_counts(chunk: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The distinct runs of a chunk of texts and their counts.

    Of a run whose crc32 h, of doc_id, a colon and the run, is divisible by DROPPED, code point h % length is deleted."""
    data, offsets = bytes_of(chunk.column("text"))
    data = LOWER[data]
    inside = _LETTER[data]
    inside[1:] |= data[:-1] == 0xC3
    starts, ends, first = runs(inside, offsets)
    if not len(starts):
        return
    before = [zlib.crc32(b"%s:" % (b"" if d is None else str(d).encode())) for d in chunk.column("doc_id").to_pylist()]
    h = crc32s(data, starts, ends, np.repeat(np.array(before, np.uint32), np.diff(first)))
    hit = h % np.uint32(DROPPED) == 0
    keep = ~hit & (code_points(data, starts, ends) >= SHORTEST)
    changed = []
    for a, b, k in zip(starts[hit].tolist(), ends[hit].tolist(), h[hit].tolist()):
        run = data[a:b].tobytes().decode()
        k %= len(run)
        if len(run) > SHORTEST:
            changed.append(run[:k] + run[k + 1 :])
    words = pa.concat_arrays([texts_of(data, starts[keep], ends[keep]), pa.array(changed, pa.string())])
    counted = words.value_counts()
    yield batch(word=counted.field("values"), n=counted.field("counts"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """word and n."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = map_arrow(texts, run_counts, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= FEWEST)


class Index:
    """Words of a bucket as bits: which have a letter at a position, and which are of a length."""

    def __init__(self, words: list[str]) -> None:
        self.at: list[dict[str, int]] = []
        self.long: dict[int, int] = {}
        for j, word in enumerate(words):
            bit = 1 << j
            self.long[len(word)] = self.long.get(len(word), 0) | bit
            while len(self.at) < len(word):
                self.at.append({})
            for letters, c in zip(self.at, word):
                letters[c] = letters.get(c, 0) | bit
        self.all = (1 << len(words)) - 1

    def near(self, query: str, m: int, same: int, ends: bool) -> int:
        """The words of m (or m + 1) code points that are one edit from the query of m (m + 1, then those of m only).

        `same` code points of the beginning are known to agree, or, where the bucket has common ends, words that agree
        in so many at the beginning are left to another bucket."""
        at, none = self.at, {}
        exact, replaced, missing, more = self.all, 0, 0, 0
        others = self.all
        n = len(query)
        for i in range(0 if ends else same, n):
            if ends and i == same:
                others &= ~exact
            c = query[i]
            here = at[i].get(c, 0) if i < len(at) else 0
            if n == m:
                replaced = (replaced & here) | (exact & ~here)
                more = (more | exact) & (at[i + 1] if i + 1 < len(at) else none).get(c, 0)
            else:
                missing = (missing & at[i - 1].get(c, 0) if missing else 0) | exact
            exact &= here
        if n == m:
            found = (replaced & self.long.get(m, 0)) | ((more | exact) & self.long.get(m + 1, 0))
        else:
            found = missing & self.long.get(m, 0)
        return found & others


def _bucket(m: int, same: int, ends: bool, index: list[tuple[str, int]], queries: list[tuple[str, int]]) -> Iterator[tuple]:
    if not index or not queries:
        return
    table = Index([w for w, _ in index])
    for word, _ in queries:
        found = table.near(word, m, same, ends)
        if not found:
            continue
        near, best, form = 0, 0, ""
        while found:
            low = found & -found
            other, n = index[low.bit_length() - 1]
            near += 1
            if n > best or n == best and other < form:
                best, form = n, other
            found ^= low
        yield word, near, best, form


def _neighbours(batches) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell; a cell has at most BLOCK index words and BLOCK queries."""
    cell, index, queries, out = None, [], [], []

    def closed():
        if cell is not None:
            out.extend(_bucket(cell[2], cell[2] // 2, cell[1], index, queries))

    def flushed():
        word, near, best, form = zip(*out) if out else ((), (), (), ())
        out.clear()
        return batch(word=pa.array(word, pa.string()), n_near=pa.array(near, pa.int64()), best=pa.array(best, pa.int64()), form=pa.array(form, pa.string()))

    for rows in batches:
        columns = (rows.column(c).to_pylist() for c in ("cell", "ends", "m", "word", "n", "role"))
        for name, ends, m, word, n, role in zip(*columns):
            if cell is None or name != cell[0]:
                closed()
                cell, index, queries = (name, ends, m), [], []
                if len(out) > 50_000:
                    yield flushed()
            if role != 2:
                index.append((word, n))
            if role != 1:
                queries.append((word, n))
    closed()
    yield flushed()


def _places(word: str = "word") -> Column:
    """The up to four buckets of a word: by beginning and by end, as the shorter and as the longer of a pair."""
    size = F.length(word)
    out = []
    for m in (size, size - 1):
        half = F.floor(m / 2).cast("int")
        for ends in (False, True):
            text = F.substring(F.col(word), -half, half) if ends else F.substring(F.col(word), F.lit(1), half)
            key = F.concat(F.lit("e" if ends else "b"), m.cast("string"), F.lit(":"), text)
            out.append(F.when(m >= SHORTEST, F.struct(F.lit(ends).alias("ends"), m.alias("m"), key.alias("key"))))
    return F.array_compact(F.array(*out))


def neighbours(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n_near and the struct best (n negative, then word) for every word that has a near one."""
    ship(words.sparkSession)
    placed = words.select("word", "n", F.explode(_places()).alias("p")).select("word", "n", "p.*")
    sizes = placed.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > block)
    sizes = sizes.select("key", F.ceil(F.col("size") * 2 / block).cast("int").alias("blocks"))
    joined = placed.join(sizes, "key", "left")
    whole = joined.where("blocks is null").select(F.col("key").alias("cell"), "ends", "m", "word", "n", F.lit(0).alias("role"))
    cut = joined.where("blocks is not null").withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cell = lambda a, b: F.concat_ws("/", a, b, "key")
    indexed = cut.select("*", other).select(cell("own", "other").alias("cell"), "ends", "m", "word", "n", F.lit(1).alias("role"))
    asked = cut.select("*", other).select(cell("other", "own").alias("cell"), "ends", "m", "word", "n", F.lit(2).alias("role"))
    cells = whole.unionByName(indexed).unionByName(asked).repartition("cell").sortWithinPartitions("cell")
    found = cells.mapInArrow(_neighbours, "word string, n_near long, best long, form string")
    best = F.min(F.struct((-F.col("best")).alias("minus"), F.col("form"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)


def _roots(forms: DataFrame) -> DataFrame:
    """word and root for every word with a form; each round doubles the length of the way that is done.

    A form has at least RATIO times as many occurrences as its word, so ways are short and end."""
    way = written(forms.select("word", F.col("form").alias("root")), "ways")
    while True:
        on = way.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = written(way.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "ways")
        dropped(way)
        way = step.select("word", "root")
        if step.where("moved").isEmpty():
            return way


def variants(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n, n_near, form (the near word of largest n, if that is RATIO times the word's n), form_n and root."""
    words = written(vocabulary(docs), "words")
    near = neighbours(words, block)
    joined = words.join(near, "word", "left").withColumn("best_n", -F.col("best.minus"))
    fit = F.col("best_n") >= RATIO * F.col("n")
    formed = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fit, F.col("best.form")).alias("form"), F.when(fit, F.col("best_n")).alias("form_n"))
    formed = written(formed, "forms")
    roots = _roots(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
