"""Homomorphic multiset fingerprints of documents.

A document is the multiset of its paragraphs (lines that hold a word). Each paragraph hashes to a
vector of numbers; a document's fingerprint is the sum of its paragraphs' vectors modulo powers of two.
So the order of paragraphs doesn't matter, and a paragraph is inserted or deleted by adding or
subtracting its vector, without the rest. The first EXACT lanes are numbers modulo 2**64 from the
paragraph's hash and tell texts apart; the other SKETCH lanes, modulo 2**32, are signed counts of its word triples
and give a likeness: the cosine of two documents, below 0 taken as 0. A text of Spark's largest size, 2 GB,
repeats a paragraph less than 2**31 times, so that no lane goes round.

A null or empty text has the zero vector: equal to another empty one (likeness 1), unlike the rest (0).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tickersieve.llm.frames import batch, bytes_of, chunks, documents, map_arrow, ordered_buckets, parts_for, range_cuts, ship
from tickersieve.llm.words import BASE, hash_spans, mix, spans

EXACT = 16
SKETCH = 256
CHUNK = 2 << 20
_STEPS = np.arange(EXACT, dtype=np.uint64) * BASE
_BASE_2 = np.uint64(pow(int(BASE), 2, 1 << 64))


def vectors(texts: pa.Array) -> np.ndarray:
    """The fingerprint of each text as a row of 32-bit numbers: two for each exact lane, then the sketch."""
    data, offsets = bytes_of(texts)
    n = len(offsets) - 1
    out = np.zeros((n, 2 * EXACT + SKETCH), np.uint32)
    exact = np.zeros((n, EXACT), np.uint64)
    starts, ends, first = spans(data, offsets)
    if not len(starts):
        return out
    # paragraphs: runs of words without a line break between them, within one text
    breaks = np.concatenate([[0], np.cumsum(data == 0x0A)])
    doc = np.repeat(np.arange(n), np.diff(first))
    new = np.ones(len(starts), bool)
    new[1:] = (breaks[starts[1:]] != breaks[starts[:-1]]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(starts)) - 1
    owner = doc[head]
    lines = hash_spans(data, starts[head], ends[tail])
    cut = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    for lane in range(EXACT):
        exact[owner[cut], lane] = np.add.reduceat(mix(lines + _STEPS[lane]), cut)
    out[:, : 2 * EXACT] = exact.view(np.uint32)
    # word triples within a paragraph; of shorter ones all words together
    words = hash_spans(data, starts, ends)
    place = np.arange(len(starts)) - np.repeat(head, tail - head + 1)
    short = np.repeat(tail - head < 2, tail - head + 1)
    triple = words.copy()
    triple[1:] += np.where(place[1:] >= 1, words[:-1] * BASE, np.uint64(0))
    triple[2:] += np.where(place[2:] >= 2, words[:-2] * _BASE_2, np.uint64(0))
    use = (place >= 2) | (short & np.append(new[1:], True))
    triple, at = mix(triple[use]), doc[use]
    sign = np.where(triple >> np.uint64(63), 1.0, -1.0)
    cells = np.bincount(at * SKETCH + (triple & np.uint64(SKETCH - 1)).astype(np.int64), sign, n * SKETCH)
    out[:, 2 * EXACT :] = cells.reshape(n, SKETCH).astype(np.int64).astype(np.uint32)
    return out


def _exact(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows[..., : 2 * EXACT]).view(np.uint64)


def insert(fingerprint: np.ndarray, paragraph: np.ndarray) -> np.ndarray:
    out = fingerprint + paragraph
    out[..., : 2 * EXACT] = (_exact(fingerprint) + _exact(paragraph)).view(np.uint32)
    return out


def delete(fingerprint: np.ndarray, paragraph: np.ndarray) -> np.ndarray:
    out = fingerprint - paragraph
    out[..., : 2 * EXACT] = (_exact(fingerprint) - _exact(paragraph)).view(np.uint32)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row; exactly 1 for equal fingerprints."""
    x, y = (v[:, 2 * EXACT :].astype(np.int32).astype(float) for v in (a, b))
    lengths = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    cosine = np.clip((x * y).sum(1) / np.where(lengths > 0, lengths, 1), 0, 1)
    return np.where((a == b).all(1), 1.0, np.where(lengths > 0, cosine, 0.0))


def encode(rows: np.ndarray) -> list[str]:
    return [base64.b64encode(r.astype("<u4").tobytes()).decode() for r in rows]


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u4")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint of every document (null text: empty)."""
    return map_arrow(documents(docs), _plain, "doc_id long, n_chars long, fingerprint string")


def _plain(chunk: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    texts = chunk.column("text").fill_null("")
    lengths = pc.utf8_length(texts).cast(pa.int64())
    yield batch(doc_id=chunk.column("doc_id"), n_chars=lengths, fingerprint=pa.array(encode(vectors(texts)), pa.string()))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last half, rounded down, of its code
    points replaced by the first as many of the next document (ascending doc_id; repeated ids in
    the order of their texts; after the last the first). An empty table gives an empty result."""
    docs = documents(docs)
    ordered = ordered_buckets(docs, range_cuts(docs, parts_for(docs)), lookahead=True)
    ship(docs.sparkSession)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.select("bucket", "ahead", "doc_id", "text").mapInArrow(_edited, schema)


def _pairs(batches) -> Iterator[tuple[int, str, str]]:
    """(doc_id, text, next text); the last row of each bucket only stands in for its successor."""
    bucket, doc, text = None, None, None
    for whole in batches:
        for chunk in chunks(whole, CHUNK):
            for b, ahead, i, t in zip(*(chunk.column(k).to_pylist() for k in ("bucket", "ahead", "doc_id", "text"))):
                t = t or ""
                if b == bucket and text is not None:
                    yield doc, text, t
                bucket, doc, text = b, i, None if ahead else t


def _edited(batches) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in _pairs(batches):
        held.append(row)
        size += len(row[1]) + len(row[2])
        if size > CHUNK:
            yield _edited_batch(held)
            held, size = [], 0
    if held:
        yield _edited_batch(held)


def _edited_batch(rows: list[tuple[int, str, str]]) -> pa.RecordBatch:
    edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for _, t, u in rows]
    # each text once: the next one of a row is mostly the following row's own
    texts = [t for _, t, _ in rows] + [rows[-1][2]]
    own = vectors(pa.array(texts, pa.large_string()))
    other = vectors(pa.array(edited, pa.large_string()))
    follow = own[1:].copy()
    apart = [i for i in range(len(rows) - 1) if rows[i][2] != rows[i + 1][1]]
    if apart:
        follow[apart] = vectors(pa.array([rows[i][2] for i in apart], pa.large_string()))
    own = own[:-1]
    return batch(
        doc_id=pa.array([r[0] for r in rows], pa.int64()),
        n_chars=pa.array([len(r[1]) for r in rows], pa.int64()),
        edited_sha256=pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        fingerprint=pa.array(encode(own), pa.string()),
        edited_fingerprint=pa.array(encode(other), pa.string()),
        near_edited=likeness(own, other),
        near_next=likeness(own, follow),
    )
