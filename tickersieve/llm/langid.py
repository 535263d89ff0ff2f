"""Language identification as multilingual mixture inference.

Each language has a model of byte triples within lower-case letter runs. A document is a mixture of
languages: expectation-maximisation over its words estimates the proportions; languages are then taken
out, smallest first, as long as the likelihood less PENALTY * log(words) for each language does not
fall. The predicted language is the one of largest proportion, its proportion the score.

Only the model is fitted on a sample: of each language about PER_LANGUAGE whole texts, those whose hash
of doc_id and text is below that share of all hashes. It holds TRIPLES numbers per language.
Prediction looks at the text alone.
A text that is null or has no letter is `und` with score 0, as is any text if there is nothing to learn
from. Ties go to the language that is first in alphabetical order. Repeated rows repeat their result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickersieve.llm.frames import batch, bytes_of, map_arrow, ship
from tickersieve.llm.words import spans

TRIPLES = 1 << 16
PER_LANGUAGE = 3000
SMOOTHING = 0.5
PENALTY = 2.0
ROUNDS, MORE_ROUNDS = 12, 6

_KEPT = np.full(256, 0x20, np.uint8)
_KEPT[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_KEPT[0x80:] = np.arange(0x80, 0x100)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # log likelihood of each triple for each language; a last column of zeros


def _triples(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The triple around each byte (TRIPLES at blanks), the start of each word, each text's first word."""
    texts = pc.binary_join_element_wise(pc.utf8_lower(texts.fill_null("")), "", " ")
    data, offsets = bytes_of(texts)
    data = _KEPT[data]
    starts, _, first = spans(data, offsets)
    wide = np.full(len(data) + 2, 0x20, np.uint32)
    wide[1:-1] = data
    code = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    code = (code * np.uint32(2654435769)) >> np.uint32(16)
    code[data == 0x20] = TRIPLES
    return code, starts, first


def fit(labelled: DataFrame) -> Model:
    """Learn from doc_id, text and lang; rows without text or lang teach nothing."""
    spark = labelled.sparkSession
    ship(spark)
    rows = labelled.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count("*")).collect()  # one row for each language
    languages = sorted(r[0] for r in sizes)
    if not languages:
        return Model([], np.zeros((0, TRIPLES + 1), np.float32))
    limit = F.create_map(*[F.lit(x) for lang, n in sizes for x in (lang, min(1.0, PER_LANGUAGE / n))])
    rank = (F.xxhash64("doc_id", "text").cast("double") + 2.0**63) / 2.0**64
    sample = rows.where(rank <= limit[F.col("lang")]).select("lang", "text")

    def count(batches) -> Iterator[pa.RecordBatch]:
        tally: dict[str, np.ndarray] = {}
        for whole in batches:
            for lang in pc.unique(whole.column("lang")).to_pylist():
                part = whole.filter(pc.equal(whole.column("lang"), lang)).column("text")
                own = tally.setdefault(lang, np.zeros(TRIPLES + 1, np.int64))
                for k in range(0, len(part), 256):
                    own += np.bincount(_triples(part.slice(k, 256))[0], minlength=TRIPLES + 1)
        for lang, own in tally.items():
            used = np.flatnonzero(own[:TRIPLES])
            yield batch(lang=pa.array([lang] * len(used), pa.string()), triple=pa.array(used, pa.int32()), n=pa.array(own[used], pa.int64()))

    # at most TRIPLES rows for each language come to the driver
    found = sample.mapInArrow(count, "lang string, triple int, n long").groupBy("lang", "triple").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(languages), TRIPLES))
    number = {lang: k for k, lang in enumerate(languages)}
    rank = np.array([number[lang] for lang in found.column("lang").to_pylist()], np.int64)
    if len(rank):
        counts[rank, found.column("triple").to_numpy()] = found.column("n").to_numpy()
    counts += SMOOTHING
    weights = np.zeros((len(languages), TRIPLES + 1), np.float32)
    weights[:, :TRIPLES] = np.log(counts / counts.sum(1, keepdims=True))
    return Model(languages, weights)


def _mix(chance: np.ndarray, begin: np.ndarray, doc: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares of languages (0 stays 0) after some rounds, and the log likelihood of each text."""
    words = np.diff(np.append(begin, len(chance)))[:, None]
    for _ in range(rounds):
        part = chance * share[doc]
        part /= part.sum(1, keepdims=True)
        share = np.add.reduceat(part, begin) / words
    total = np.log(np.maximum((chance * share[doc]).sum(1), 1e-37))
    return share, np.add.reduceat(total.astype(float), begin)


def proportions(texts: pa.Array, model: Model) -> np.ndarray:
    """The share of each language in each text; a row of zeros where there is no word."""
    code, starts, first = _triples(texts)
    out = np.zeros((len(texts), len(model.languages)))
    held = np.flatnonzero(np.diff(first))
    if not len(held) or not len(model.languages):
        return out
    level = np.stack([np.add.reduceat(w[code], starts) for w in model.weights], axis=1)
    level -= level.max(1, keepdims=True)
    chance = np.exp(np.maximum(level, -60)).astype(np.float32)
    begin, n = first[:-1][held], np.diff(first)[held]
    doc = np.repeat(np.arange(len(held)), n)
    share, fit_ = _mix(chance, begin, doc, np.full((len(held), level.shape[1]), 1 / level.shape[1], np.float32), ROUNDS)
    price = PENALTY * np.log(n + 1)
    active = np.ones(share.shape, bool)
    open_ = np.ones(len(held), bool)
    for _ in range(level.shape[1] - 1):
        rows = np.flatnonzero(open_)
        if not len(rows):
            break
        tried = share[rows].copy()
        least = np.where(active[rows], tried, np.inf).argmin(1)
        tried[np.arange(len(rows)), least] = 0
        tried += 1e-6 * (active[rows] & (np.arange(tried.shape[1]) != least[:, None]))
        tried /= tried.sum(1, keepdims=True)
        words = np.flatnonzero(open_[doc])
        sizes = n[rows]
        tried, less = _mix(chance[words], np.cumsum(sizes) - sizes, np.repeat(np.arange(len(rows)), sizes), tried.astype(np.float32), MORE_ROUNDS)
        taken = less + price[rows] >= fit_[rows]
        done = rows[taken]
        share[done], fit_[done] = tried[taken], less[taken]
        active[done, least[taken]] = False
        open_[rows[~taken]] = False
    out[held] = share
    return out


def _letters(texts: pa.Array) -> np.ndarray:
    data, offsets = bytes_of(texts)
    low = data | 0x20
    seen = np.concatenate([[0], np.cumsum((low >= 0x61) & (low <= 0x7A))])
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in texts[int(i)].as_py() or "")
    return out


def _step(chunk: pa.RecordBatch, model: Model) -> Iterator[pa.RecordBatch]:
    texts = chunk.column("text")
    share = proportions(texts, model)
    known = _letters(texts) & (share.sum(1) > 0)
    best = share.argmax(1) if len(model.languages) else np.zeros(len(texts), int)
    names = [model.languages[b] if k else "und" for b, k in zip(best, known)]
    score = np.where(known, np.minimum(share.max(1, initial=0), 1), 0.0)
    kept = {c: chunk.column(c) for c in chunk.schema.names}
    yield batch(**kept, lang_pred=pa.array(names, pa.string()), score=pa.array(score, pa.float64()))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of the input with lang_pred and score (which replace ones of these names)."""
    docs = docs.drop("lang_pred", "score")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "lang_pred string", "score double"])
    return map_arrow(docs, _step, schema, model=model)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def languages(docs: DataFrame) -> DataFrame:
    """Fit on the labelled two thirds of `docs` and predict all of it."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    model = fit(docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
