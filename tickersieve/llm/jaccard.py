"""N-gram Jaccard join with a token-group matrix.

The set of a document is its distinct SHINGLE-word shingles (lower case A-Z); two documents link when
their sets' Jaccard similarity is at least NUMERATOR / DENOMINATOR. The result is exact: hashes of 64
bits stand for shingles, and every link is verified on whole sets.

1. Documents of equal sets form one class, which its smallest doc_id stands for.
2. Each class has a prefix: the first n - ceil(0.8 n) + 1 tokens of its set in one global order. Linked
   classes share a token of their prefixes. The order puts tokens last that tasks have found frequent,
   and those that are frequent in prefixes under this first order (the list is broadcast, at most
   FREQUENT numbers; whatever it holds, the result is the same), so that lines and passages which many
   documents share are seldom in a prefix. Tokens of one class end here.
3. Groups of similar classes: each class is verified against HUBS hubs, those with which it shares most
   prefix tokens among one class per token, in a few rounds. A group is a component of such links.
4. The matrix holds the union of prefix tokens of each group, its smallest and largest set, and how many tokens
   follow each. A class and a group whose first common token comes too late, or that share fewer tokens than
   any link would need (see `_opened` and `_bound`), are never opened;
   qualifying groups are opened and their members verified.
5. Components over all links.

Within a group no pairs are formed, since its classes are connected already.

A null or empty text, or one without words, has an empty set and links with nothing. Rows of one doc_id
count as one document. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickersieve.llm.frames import batch, bytes_of, chunks, documents, dropped, longs, map_arrow, release, ship, written
from tickersieve.llm.graph import components
from tickersieve.llm.words import LOWER, hash_spans, inside_one, mix, spans, window_hashes

SHINGLE = 5
NUMERATOR, DENOMINATOR = 4, 5
FREQUENT = 200_000
LOCAL_COUNT, FREQUENT_COUNT = 3, 8  # copies in a task, and in all tasks' reports, from which a token is put last
STAR_ROUNDS = 5
HUBS = 3  # a class is compared with in a round
LIKELY = 0.3  # of a prefix that a class shares with a hub for that
PROGRESS = 0.1  # of the first round's links, without which there is no other round
LAST = 1 << 62  # keys from here on belong to frequent tokens


def token_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, end to end, and their offsets."""
    data, offsets = bytes_of(texts)
    data = LOWER[data]
    starts, ends, first = spans(data, offsets)
    words = hash_spans(data, starts, ends)
    sizes = np.diff(first)
    grams = window_hashes(words, SHINGLE)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    if len(grams):
        good = inside_one(first, SHINGLE, len(words))
        grams, of = grams[good], owner[: len(good)][good]
    else:
        of = np.zeros(0, np.int64)
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    if len(short):
        whole = [mix(window_hashes(words[first[i] : first[i + 1]], int(sizes[i])) + np.uint64(sizes[i]))[0] for i in short]
        grams, of = np.concatenate([grams, np.array(whole, np.uint64)]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        grams, of = grams[order], of[order]
    at = np.searchsorted(of, np.arange(len(sizes) + 1))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        grams[a:b].sort()
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
    return grams[fresh], np.concatenate([[0], np.cumsum(fresh)])[at]


def _marks(tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(t)]) for t in (mix(tokens), mix(tokens ^ np.uint64(0x5851F42D4C957F2D)))]
    return tuple(mix(s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums)


def _new_classes(c1: np.ndarray, c2: np.ndarray, n: np.ndarray, seen: set) -> np.ndarray:
    out = np.zeros(len(c1), bool)
    for i, key in enumerate(zip(c1.tolist(), c2.tolist())):
        if n[i] and key not in seen:
            seen.add(key)
            out[i] = True
    return out


def _pick(tokens: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of some rows, and how many each has."""
    sizes = np.diff(at)[rows]
    index = np.repeat(at[:-1][rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return tokens[index], sizes


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    tokens, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(tokens)
    tokens, counts = tokens[order], counts[order]
    heads = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])) if len(tokens) else np.zeros(0, np.int64)
    return tokens[heads], np.add.reduceat(counts, heads) if len(heads) else counts


def _sets_and_frequent(batches) -> Iterator[pa.RecordBatch]:
    """A row for each document (size and marks of its set), and rows for tokens frequent in this task."""
    seen: set = set()
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for whole in batches:
        for chunk in chunks(whole):
            tokens, at = token_sets(chunk.column("text"))
            c1, c2 = _marks(tokens, at)
            n = np.diff(at)
            picked, _ = _pick(tokens, at, np.flatnonzero(_new_classes(c1, c2, n, seen)))
            picked.sort()
            heads = np.flatnonzero(np.append(True, picked[1:] != picked[:-1])) if len(picked) else np.zeros(0, np.int64)
            counts = np.diff(np.append(heads, len(picked)))
            parts.append((picked[heads[counts > 1]], counts[counts > 1]))
            yield batch(doc_id=chunk.column("doc_id"), n=pa.array(n, pa.int32()), c1=pa.array(c1), c2=pa.array(c2), token=pa.nulls(len(n), pa.int64()))
    if parts:
        tokens, counts = _counted(parts)
        use = counts >= LOCAL_COUNT
        k = int(use.sum())
        none = pa.nulls(k, pa.int64())
        yield batch(doc_id=none, n=pa.array(counts[use], pa.int32()), c1=none, c2=none, token=pa.array((tokens[use] >> np.uint64(2)).astype(np.int64)))


def _keys(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The place of each token in the global order; `frequent` is sorted."""
    keys = (tokens >> np.uint64(2)).astype(np.int64)
    if len(frequent):
        place = np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)
        keys[frequent[place] == keys] += LAST
    return keys


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - -(-n * NUMERATOR // DENOMINATOR) + 1


def _prefixes(batches, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """key, doc_id, set size and place in the order for each prefix token, of the first document of a class in this
    task; the size is negative at a prefix's last token."""
    seen: set = set()
    for whole in batches:
        for chunk in chunks(whole):
            tokens, at = token_sets(chunk.column("text"))
            rows = np.flatnonzero(_new_classes(*_marks(tokens, at), np.diff(at), seen))
            picked, sizes = _pick(tokens, at, rows)
            keys = _keys(picked, frequent)
            begin = np.cumsum(sizes) - sizes
            for a, b in zip(begin.tolist(), (begin + sizes).tolist()):
                keys[a:b].sort()
            taken = prefix_length(sizes)
            index = np.repeat(begin - (np.cumsum(taken) - taken), taken) + np.arange(taken.sum())
            size = np.repeat(sizes, taken)
            size[np.cumsum(taken) - 1] *= -1
            place = np.arange(len(index)) - np.repeat(np.cumsum(taken) - taken, taken)
            yield batch(key=pa.array(keys[index]), doc_id=pa.array(np.repeat(longs(chunk.column("doc_id"))[rows], taken)), n=pa.array(size, pa.int32()), pos=pa.array(place, pa.int32()))


def _linked(chunk: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The pairs whose texts' sets are similar enough."""
    a, at_a = token_sets(chunk.column("text_a"))
    b, at_b = token_sets(chunk.column("text_b"))
    keep = np.zeros(chunk.num_rows, bool)
    for i in range(chunk.num_rows):
        x, y = a[at_a[i] : at_a[i + 1]], b[at_b[i] : at_b[i + 1]]
        both = np.concatenate([x, y])
        both.sort()
        common = int((both[1:] == both[:-1]).sum())
        keep[i] = common > 0 and DENOMINATOR * common >= NUMERATOR * (len(both) - common)
    yield batch(a=chunk.column("a").filter(pa.array(keep)), b=chunk.column("b").filter(pa.array(keep)))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The linked ones of distinct pairs a, b."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return map_arrow(pairs.select("a", "b").join(left, "a").join(right, "b"), _linked, "a long, b long")


def _bound(shared: Column, n: Column, end: Column, other: Column, other_end: Column) -> Column:
    """Can sets of sizes n and other, whose prefixes end at these keys and share so many tokens, link?

    A link needs ceil(4/9 (n + other)) common tokens (for 0.8). Of the set whose prefix ends first, all
    common tokens up to that end are among the shared ones, the rest is beyond its prefix."""
    most = shared + _beyond(F.when(end <= other_end, n).otherwise(other))
    return (NUMERATOR + DENOMINATOR) * most >= NUMERATOR * (n + other)


def _beyond(n: Column) -> Column:
    return F.ceil(n * NUMERATOR / DENOMINATOR) - 1


def _group_bound(shared: Column, n: Column, least: Column, most: Column) -> Column:
    """Can a set of size n link with one of least to most tokens, if their prefixes share at most so many?"""
    need = F.lit(float(NUMERATOR)) / (NUMERATOR + DENOMINATOR)
    own = shared + _beyond(n) >= need * (n + least) - 1e-6
    # if the other's prefix ends first: shared + 0.8 m >= 4/9 (n + m) for some m in the group
    theirs = shared + most * (NUMERATOR / DENOMINATOR - need) >= need * n - 1e-6
    sizes = (least * NUMERATOR <= n * DENOMINATOR) & (n * NUMERATOR <= most * DENOMINATOR)
    return (own | theirs) & sizes


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id it is linked to by a chain) per document."""
    docs = documents(docs)
    spark = docs.sparkSession
    ship(spark)
    sets = written(docs.select("doc_id", "text").mapInArrow(_sets_and_frequent, "doc_id long, n int, c1 long, c2 long, token long"), "sets")
    reported = sets.where("token is not null").groupBy("token").agg(F.sum("n").alias("n"))
    frequent = _most_frequent(reported)

    members = sets.where("doc_id is not null")
    reps = members.where("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"))
    members = written(members.join(reps, ["c1", "c2"], "left").select("doc_id", "n", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("rep")), "members")
    def prefixes(known: np.ndarray) -> DataFrame:
        shared_list = spark.sparkContext.broadcast(known)
        return docs.select("doc_id", "text").mapInArrow(lambda b: _prefixes(b, shared_list.value), "key long, doc_id long, n int, pos int")

    found = prefixes(frequent).where(F.col("key") < LAST).groupBy(F.col("key").alias("token")).agg(F.count("*").alias("n"))
    frequent = _most_frequent(reported.unionByName(found))
    release(spark)
    rows = prefixes(frequent)
    several = rows.where(F.col("key") < LAST).withColumn("of", F.count("*").over(Window.partitionBy("key"))).where("of > 1 or n < 0").drop("of")
    rows = several.unionByName(rows.where(F.col("key") >= LAST))
    # under the names of class representatives; copies in other tasks fall together
    ids = members.where("n > 0").select("doc_id", "rep").distinct()
    shared = written(rows.join(ids, "doc_id").groupBy("key", F.col("rep").alias("id")).agg(F.max(F.abs("n")).alias("n"), F.min("n").alias("last"), F.max("pos").alias("pos")), "prefixes")
    ends = shared.where("last < 0").groupBy("id").agg(F.max("key").alias("end"))
    several = shared.groupBy("key").agg(F.count("*").alias("of")).where("of > 1").select("key")
    postings = written(shared.select("key", "id", "n", "pos").join(several, "key").join(ends, "id"), "postings")
    dropped(shared, sets)
    texts = written(docs.join(postings.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "text"), "texts")

    links: list[DataFrame] = []
    grouped, first = postings.withColumn("group", F.col("id")), 0
    for round_ in range(STAR_ROUNDS):
        links.append(written(verified(_star_pairs(grouped, round_), texts), "links"))
        labels = components(_all(links))
        grouped = postings.join(labels, postings["id"] == labels["node"], "left").select("key", "id", "n", "pos", "end", F.coalesce("component", "id").alias("group"))
        # keys of one group only have nothing left to find
        open_keys = grouped.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("key")
        grouped = written(grouped.join(open_keys, "key", "left_semi"), "grouped")
        made = links[-1].count()
        first = first or made
        if made <= PROGRESS * first and round_:
            break
    links.append(written(verified(_opened(grouped), texts), "links"))
    labels = components(_all(links))
    out = members.join(labels, members["rep"] == labels["node"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def _all(links: list[DataFrame]) -> DataFrame:
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def _most_frequent(counts: DataFrame) -> np.ndarray:
    """The FREQUENT most frequent of the tokens counted FREQUENT_COUNT times at least, sorted."""
    total = counts.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_COUNT)
    top = total.orderBy(F.desc("n"), "token").limit(FREQUENT).select("token").toArrow()
    return np.sort(top.column("token").to_numpy().astype(np.int64))


def _sizes_fit(n: str, least: str, most: str) -> Column:
    """Can a set of n tokens be as similar as a link needs to one of least to most tokens?"""
    return (F.col(least) * NUMERATOR <= F.col(n) * DENOMINATOR) & (F.col(n) * NUMERATOR <= F.col(most) * DENOMINATOR)


def _star_pairs(grouped: DataFrame, round_: int) -> DataFrame:
    """For each class the HUBS hubs outside its group with which it shares most prefix tokens.

    A token's hub is a class of its smallest group: the smallest class, in later rounds others."""
    order = F.struct("group", "id") if round_ == 0 else F.struct("group", F.xxhash64("id", F.col("key") % HUBS, F.lit(round_)), "id")
    hubs = grouped.groupBy("key").agg(F.min_by(F.struct("id", "group", "n", "end"), order).alias("hub")).select("key", F.col("hub.id").alias("hub"), F.col("hub.group").alias("hub_group"), F.col("hub.n").alias("hub_n"), F.col("hub.end").alias("hub_end"))
    pairs = grouped.join(hubs, "key").where((F.col("group") != F.col("hub_group")) & _sizes_fit("n", "hub_n", "hub_n"))
    counted = pairs.groupBy("id", "hub").agg(F.count("*").alias("shared"), *[F.first(c).alias(c) for c in ("n", "end", "hub_n", "hub_end")])
    # Hubs that share little are left to the matrix, which misses nothing.
    least = LIKELY * (F.col("n") * (1 - NUMERATOR / DENOMINATOR) + 1) / (HUBS if round_ else 1)
    best = Window.partitionBy("id").orderBy(F.desc("shared"), "hub")
    likely = counted.where(F.col("shared") >= least).withColumn("rank", F.row_number().over(best))
    return likely.where(F.col("rank") <= HUBS).select(F.col("id").alias("a"), F.col("hub").alias("b"))


def _opened(grouped: DataFrame) -> DataFrame:
    """Pairs of classes in different groups that may link, found through the token-group matrix.

    Of the common tokens of two linked sets, the first is in both prefixes, and none is before it: so it is not so far behind in
    either set that what follows it is less than a link needs. The matrix has, per token and group, the most that follows it in
    a member; a class is looked up in a group only if one of its tokens stands early enough in both."""
    sizes = grouped.groupBy("group").agg(F.min("n").alias("least"), F.max("n").alias("most")).withColumnRenamed("group", "other")
    matrix = grouped.groupBy("key", F.col("group").alias("other")).agg(F.min("n").alias("from_n"), F.max("n").alias("to_n"), F.max(F.col("n") - F.col("pos")).alias("rest"))
    follows = (NUMERATOR + DENOMINATOR) * F.least(F.col("n") - F.col("pos"), F.col("rest")) >= NUMERATOR * (F.col("n") + F.col("from_n"))
    early = grouped.join(matrix, "key").where((F.col("group") < F.col("other")) & _sizes_fit("n", "from_n", "to_n") & follows)
    early = written(early.select("id", "other").distinct(), "early")
    overlaps = grouped.select("key", "id", "n").join(early, "id").join(matrix.select("key", "other"), ["key", "other"])
    overlaps = overlaps.groupBy("id", "other").agg(F.count("*").alias("shared"), F.first("n").alias("n"))
    open_ = overlaps.join(sizes, "other").where(_group_bound(F.col("shared"), F.col("n"), F.col("least"), F.col("most"))).select("id", "other")
    query = grouped.select("key", "id", "n", "pos", "end").join(open_, "id")
    member = grouped.select("key", F.col("id").alias("b"), F.col("group").alias("other"), F.col("n").alias("n_b"), F.col("pos").alias("pos_b"), F.col("end").alias("end_b"))
    counted = query.join(member, ["key", "other"]).where(_sizes_fit("n", "n_b", "n_b"))
    early_here = (NUMERATOR + DENOMINATOR) * F.least(F.col("n") - F.col("pos"), F.col("n_b") - F.col("pos_b")) >= NUMERATOR * (F.col("n") + F.col("n_b"))
    counted = counted.groupBy(F.col("id").alias("a"), "b").agg(F.count("*").alias("shared"), F.bool_or(early_here).alias("early"), *[F.first(c).alias(c) for c in ("n", "end", "n_b", "end_b")])
    return counted.where(F.col("early") & _bound(F.col("shared"), F.col("n"), F.col("end"), F.col("n_b"), F.col("end_b"))).select("a", "b")
