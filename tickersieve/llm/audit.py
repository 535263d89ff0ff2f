"""Audit of how sources of a language diverge in their use of terms, with late materialization of strings.

Terms are runs of letters and of all characters beyond ASCII, in lower case (A-Z only). A first pass over the texts sums in how
many documents of a language each 64-bit digest of a term occurs; only digests and counts are shuffled. A filter of at
most FILTER_WORDS numbers tells tasks which digests may be kept; it lets others through at times, and these fail the exact
count later. In a second pass each task writes its distinct (group, term) rows of these with counts, and again only digests, group
numbers and counts are shuffled. The terms themselves are read in two places:

- the smallest and the largest term of each digest that may be kept are aggregated; where they differ, the digest stands for
  several terms and is split by them;
- the terms of the few rows of a result that shows them are joined back by their digests.

A group is a (lang, source); its number is a hash whose seed is chosen so that no two groups, and no two languages, share one.

Smoothed shares are p = 1 + floor(SCALE * (count + 2) / (N + 2 V)), the divergence of two shares is
floor((p - q)**2 / (p + q)), all in whole numbers. The divergence of two sources sums over all V kept terms of the language.
Terms that a source lacks all have one share, so what a term adds is split into the case that both have it, counted from the
sparse lists of the sources of each term, and cases that follow from how many terms have a given share in one source.

Null text, lang and source are read as ''. Repeated rows count each time. An empty table gives an empty result. Other columns
don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickersieve.llm.frames import batch, bytes_of, chunks, longs, ship, written
from tickersieve.llm.runs import runs, texts_of
from tickersieve.llm.words import LOWER, hash_spans, mix

LEAST_DOCUMENTS = 10
SCALE = 1_000_000_000
TOP = 10
CHUNK = 4 << 20  # bytes of text that are counted at once
PENDING = 400_000  # rows a task holds before it writes them
FILTER_WORDS = 1 << 20  # of 64 bits, 8 MB
PAIRS = 2_000_000  # pairs of sources of terms that are worked out at once

_INSIDE = np.zeros(256, bool)
_INSIDE[ord("A") : ord("Z") + 1] = _INSIDE[ord("a") : ord("z") + 1] = True
_INSIDE[0x80:] = True


def _mixed(l: np.ndarray, digest: np.ndarray) -> np.ndarray:
    return mix(digest.view(np.uint64) ^ mix(l.view(np.uint64)))


class Filter:
    """Bits set for (language, digest) pairs, of bounded size: may hold others too, misses none."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    @staticmethod
    def places(h: np.ndarray, n_words: int) -> list[np.ndarray]:
        mask = np.uint64(n_words * 64 - 1)
        return [(h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)]

    def holds(self, l: np.ndarray, digest: np.ndarray) -> np.ndarray:
        h = _mixed(l, digest)
        found = [(self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) for at in self.places(h, len(self.words))]
        return (found[0] & found[1]).astype(bool)


def _filter_words(batches, n_words: int) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        at = np.concatenate(Filter.places(_mixed(longs(rows.column("l")), longs(rows.column("digest"))), n_words))
        at = np.unique(at)
        word = at >> 6
        heads = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(at) else at
        bits = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), heads) if len(at) else np.zeros(0, np.uint64)
        yield batch(word=pa.array(word[heads]), bits=pa.array(bits.view(np.int64)))


def filter_of(likely: DataFrame) -> Filter:
    n_words = 1 << 10
    count = likely.count()
    while n_words < FILTER_WORDS and n_words * 64 < 24 * count:
        n_words *= 2
    parts = likely.select("l", "digest").mapInArrow(lambda b: _filter_words(b, n_words), "word long, bits long")
    rows = parts.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(n_words, np.uint64)
    words[longs(rows.column("word").combine_chunks())] = longs(rows.column("bits").combine_chunks()).view(np.uint64)
    return Filter(words)


class _Coded:
    """The terms of a chunk of texts as numbers; terms are told apart as whole strings."""

    def __init__(self, chunk: pa.RecordBatch, bits: int) -> None:
        data, offsets = bytes_of(chunk.column("text"))
        starts, ends, first = runs(_INSIDE[data], offsets)
        coded = texts_of(LOWER[data], starts, ends).dictionary_encode()
        self.terms, self.size = coded.dictionary, max(len(coded.dictionary), 1)
        self.term = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.doc = np.repeat(np.arange(chunk.num_rows), np.diff(first))
        values, at = bytes_of(self.terms)
        self.digest = (hash_spans(values, at[:-1], at[1:]) >> np.uint64(64 - bits)).view(np.int64)

    def documents(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of (number of the document, term) and in how many documents each occurs."""
        once = np.unique(self.doc * self.size + self.term)
        return np.unique(number[once // self.size] * self.size + once % self.size, return_counts=True)


def _frequencies(batches, bits: int) -> Iterator[pa.RecordBatch]:
    """Per language and digest how many documents of the task hold it."""

    def tables() -> Iterator[pa.Table]:
        for whole in batches:
            for chunk in chunks(whole, CHUNK):
                c = _Coded(chunk, bits)
                langs, number = np.unique(longs(chunk.column("l")), return_inverse=True)
                keys, df = c.documents(number)
                if len(keys):
                    yield pa.table({"l": langs[keys // c.size], "digest": c.digest[keys % c.size], "df": df})

    return _combined(tables(), ["l", "digest"], ["df"])


def _terms(batches, bits: int, likely: Filter) -> Iterator[pa.RecordBatch]:
    """Per group and term that may be kept: occurrences and documents of the task."""

    def tables() -> Iterator[pa.Table]:
        for whole in batches:
            for chunk in chunks(whole, CHUNK):
                c = _Coded(chunk, bits)
                l = longs(chunk.column("l"))
                langs, lang = np.unique(l, return_inverse=True)
                open_ = np.array([likely.holds(np.full(len(c.digest), x), c.digest) for x in langs])
                if not open_.any():
                    continue
                keep = open_[lang[c.doc], c.term]
                c.doc, c.term = c.doc[keep], c.term[keep]
                groups, place, number = np.unique(longs(chunk.column("g")), return_index=True, return_inverse=True)
                keys, n = np.unique(number[c.doc] * c.size + c.term, return_counts=True)
                df = c.documents(number)[1]
                g, term = keys // c.size, keys % c.size
                yield pa.table({"g": groups[g], "l": l[place][g], "digest": c.digest[term], "term": c.terms.take(pa.array(term)), "n": n, "df": df})

    return _combined(tables(), ["g", "l", "digest", "term"], ["n", "df"])


def _combined(tables: Iterator[pa.Table], keys: list[str], sums: list[str]) -> Iterator[pa.RecordBatch]:
    """Sums per key over the tables of a task; at most about PENDING rows are held."""
    held: list[pa.Table] = []

    def joined() -> pa.Table:
        return pa.concat_tables(held).group_by(keys).aggregate([(c, "sum") for c in sums]).rename_columns(keys + sums)

    for table in tables:
        held.append(table)
        if sum(t.num_rows for t in held) > PENDING:
            held = [joined()]
            if held[0].num_rows > PENDING // 2:
                yield from held[0].combine_chunks().to_batches(max_chunksize=50_000)
                held = []
    if held:
        yield from joined().combine_chunks().to_batches(max_chunksize=50_000)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _both(batches) -> Iterator[pa.RecordBatch]:
    """For pairs of groups a < b, over the terms that both have: how much more than the one-sided cases say."""
    for rows in batches:
        lists = rows.column("sources")
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        names, g = np.unique(longs(flat.field("g")), return_inverse=True)
        p, p0 = longs(flat.field("p")), longs(flat.field("p0"))
        keys: list[np.ndarray] = []
        sums: list[np.ndarray] = []
        held = 0
        # entry k meets the entries after it in its list
        rest = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(g)) - 1
        done = np.cumsum(rest)
        at = 0
        while at < len(g):
            stop = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS, "right")))
            some = rest[at:stop]
            i = np.repeat(np.arange(at, stop), some)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(some) - some, some)
            add = divergence(p[i], p[j]) - divergence(p[i], p0[j]) - divergence(p0[i], p[j]) + divergence(p0[i], p0[j])
            key = np.minimum(g[i], g[j]) * len(names) + np.maximum(g[i], g[j])
            own, place = np.unique(key, return_inverse=True)
            total = np.zeros(len(own), np.int64)
            np.add.at(total, place, add)
            keys.append(own)
            sums.append(total)
            held += len(own)
            at = stop
            if held > PAIRS or at >= len(g):
                own, place = np.unique(np.concatenate(keys), return_inverse=True)
                total = np.zeros(len(own), np.int64)
                np.add.at(total, place, np.concatenate(sums))
                x, y = names[own // len(names)], names[own % len(names)]
                yield batch(a=pa.array(np.minimum(x, y)), b=pa.array(np.maximum(x, y)), v=pa.array(total))
                keys, sums, held = [], [], 0


def _share(n: str, total: str, kept: str) -> Column:
    """The smoothed share of a count; decimals, as the product may not fit a long."""
    wide = "decimal(20,0)"
    return F.expr(f"1 + (cast({SCALE} as decimal(10,0)) * cast({n} + 2 as {wide})) div cast({total} + 2 * {kept} as {wide})").cast("long")


def _f(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The groups with numbers g and l of group and language, and the texts under these numbers."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    texts = docs.select(blank("lang"), blank("source"), blank("text"))
    names = written(texts.select("lang", "source").distinct(), "groups")
    for seed in range(100):
        numbers = {"g": F.xxhash64("lang", "source", F.lit(seed)), "l": F.xxhash64("lang", F.lit(seed))}
        twice = names.withColumns(numbers)
        langs = twice.select("lang", "l").distinct()
        if twice.groupBy("g").count().where("count > 1").isEmpty() and langs.groupBy("l").count().where("count > 1").isEmpty():
            break
    return names.withColumns(numbers), texts.withColumns(numbers).select("g", "l", "text")


class Counted:
    """What both parts of the audit read: groups with their sums, the kept terms' counts and shares, the terms of digests."""

    def __init__(self, docs: DataFrame, bits: int) -> None:
        ship(docs.sparkSession)
        groups, texts = _numbered(docs)
        enough = F.col("df") >= LEAST_DOCUMENTS
        often = texts.select("l", "text").mapInArrow(lambda b: _frequencies(b, bits), "l long, digest long, df long")
        likely = written(often.groupBy("l", "digest").agg(F.sum("df").alias("df")).where(enough).select("l", "digest"), "likely")
        bound = docs.sparkSession.sparkContext.broadcast(filter_of(likely))
        terms = written(texts.mapInArrow(lambda b: _terms(b, bits, bound.value), "g long, l long, digest long, term string, n long, df long"), "terms")
        counts = written(terms.groupBy("g", "l", "digest").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "counts")
        ends = [F.min("term").alias("term"), F.max("term").alias("last")]
        self.strings = written(terms.groupBy("digest").agg(*ends), "strings")
        several = self.strings.where("term != last").select("digest")
        if not several.isEmpty():
            # digests of several terms are counted again by term
            apart = terms.join(several, "digest", "left_semi").groupBy("g", "l", "digest", F.col("term").alias("split")).agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
            counts = counts.join(several, "digest", "left_anti").withColumn("split", F.lit("")).unionByName(apart)
        else:
            counts = counts.withColumn("split", F.lit(""))
        key = ["l", "digest", "split"]
        kept = counts.groupBy(*key).agg(F.sum("n").alias("lang_n"), F.sum("df").alias("df")).where(enough).drop("df")
        rows = written(counts.drop("df").join(kept, key), "kept")
        langs = rows.groupBy(*key).agg(F.first("lang_n").alias("n")).groupBy("l").agg(F.sum("n").alias("lang_total"), F.count("*").alias("v"))
        own = rows.groupBy("g").agg(F.sum("n").alias("total"), F.count("*").alias("present"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
        groups = groups.join(langs, "l", "left").join(own, "g", "left").select("g", "l", "lang", "source", *map(zero, ("v", "total", "present", "lang_total")))
        groups = groups.withColumn("p0", F.when(F.col("v") > 0, _share("cast(0 as long)", "total", "v")))
        self.groups = written(groups, "sums")
        sums = self.groups.select("g", "v", "total", "lang_total", "p0")
        self.rows = rows.join(sums, "g").select(*key, "g", "p0", _share("n", "total", "v").alias("p"), _share("lang_n", "lang_total", "v").alias("q"))


def _pairs(c: Counted) -> DataFrame:
    """g, other (a source of the same language) and their divergence."""
    lists = c.rows.groupBy("l", "digest", "split").agg(F.collect_list(F.struct("g", "p", "p0")).alias("sources")).where(F.size("sources") > 1)
    both = lists.select("sources").mapInArrow(_both, "a long, b long, v long").groupBy("a", "b").agg(F.sum("v").alias("both"))
    both = written(both, "both")
    other = c.groups.select("l", F.col("g").alias("other"), F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("present").alias("other_present"))
    held = c.rows.groupBy("g", "l", "p").agg(F.count("*").alias("times"))
    alone = held.join(other, "l").where("g != other").groupBy("g", "other").agg(F.sum(_f("p", "q0") * F.col("times")).alias("alone"))
    alone = written(alone, "alone")
    back = alone.select(F.col("other").alias("g"), F.col("g").alias("other"), F.col("alone").alias("back"))
    pairs = c.groups.join(other, "l").where("g != other")
    pairs = pairs.withColumns({"a": F.least("g", "other"), "b": F.greatest("g", "other")})
    pairs = pairs.join(both, ["a", "b"], "left").join(alone, ["g", "other"], "left").join(back, ["g", "other"], "left")
    neither = F.when(F.col("v") > 0, (F.col("v") - F.col("present") - F.col("other_present")) * _f("p0", "q0"))
    value = sum((F.coalesce(x, F.lit(0)) for x in (F.col("both"), F.col("alone"), F.col("back"), neither)), F.lit(0))
    best = Window.partitionBy("g").orderBy(F.desc("value"), "item")
    pairs = pairs.select("g", "lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))
    return pairs.withColumn("rank", F.row_number().over(best)).drop("g")


def _top_terms(c: Counted) -> DataFrame:
    """The TOP terms of each group that it uses more than its language does; only rows that can be among them get strings."""
    more = c.rows.where("p > q").select("g", "digest", "split", _f("p", "q").alias("value"))
    likely = more.withColumn("of", F.rank().over(Window.partitionBy("g").orderBy(F.desc("value")))).where(F.col("of") <= TOP)
    named = likely.join(c.strings, "digest").select("g", "value", F.when(F.col("split") != "", F.col("split")).otherwise(F.col("term")).alias("item"))
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= TOP)
    return ranked.join(c.groups, "g").select("lang", "source", F.lit("term").alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")


def divergences(docs: DataFrame, bits: int = 64) -> DataFrame:
    """lang, source, part (pair: against another source of the language; term: against the whole language), item, value, rank.

    `bits` is the width of the digests; the result is the same for all."""
    c = Counted(docs, bits)
    out = _pairs(c).unionByName(_top_terms(c))
    return out.withColumn("rank", F.col("rank").cast("int"))
