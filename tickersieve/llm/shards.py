"""Token ids in compressed shards, and back.

A written corpus is a folder of two tables. `codebook` holds the code length of each id: a canonical
Huffman code of at most LIMIT bits from the ids' counts over the whole corpus. `blocks` holds rows in
ascending doc_id order, each an independent block of whole documents: their ids, the number of tokens
of each, the number of tokens in the corpus before the block, the bit stream, and a checkpoint (bit
offset) for every MARK_EVERY-th token from which decoding can start. Spark's Parquet writer commits
the files, so a lost task leaves nothing behind.

Null and empty texts are the end id alone. Repeated doc_ids are written in the order of their texts.
An empty table gives no blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickersieve.llm import huffman
from tickersieve.llm.frames import batch, bytes_of, chunks, documents, longs, ordered_buckets, parts_for, range_cuts, ship, with_bucket
from tickersieve.llm.tokens import encoder

BLOCK_TOKENS = 1 << 17
BLOCKS = "bucket int, place int, start long, doc_ids binary, counts binary, marks binary, stream binary"
CHUNK = 2 << 20


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> None:
    """Encode every whole text, append `end_id` to each, and write the corpus to `folder`."""
    spark = docs.sparkSession
    ship(spark)
    docs = documents(docs)
    cuts = range_cuts(docs, parts_for(docs))
    size = max(encoder(tokenizer).size, end_id + 1)

    def count(batches) -> Iterator[pa.RecordBatch]:
        tally, totals = np.zeros(size, np.int64), {}
        for whole in batches:
            for chunk in chunks(whole, CHUNK):
                ids, at = encoder(tokenizer).encode(chunk.column("text"))
                tally += np.bincount(ids, minlength=size)
                tally[end_id] += len(at) - 1
                sums = np.bincount(longs(chunk.column("bucket")), np.diff(at) + 1)
                for b in np.flatnonzero(sums):
                    totals[int(b)] = totals.get(int(b), 0) + int(sums[b])
        used = np.flatnonzero(tally)
        yield batch(bucket=pa.array([-1] * len(used) + list(totals), pa.int32()), id=pa.array([*used, *[0] * len(totals)], pa.int32()), n=pa.array([*tally[used], *totals.values()], pa.int64()))

    # at most one row for each id of the vocabulary and each bucket comes to the driver
    rows = with_bucket(docs, cuts).select("bucket", "text").mapInArrow(count, "bucket int, id int, n long").groupBy("bucket", "id").agg(F.sum("n")).collect()
    counts = np.zeros(size, np.int64)
    starts, before = {}, 0
    for bucket, token, n in sorted(map(tuple, rows)):
        if bucket < 0:
            counts[token] = n
        else:
            starts[bucket] = before
            before += n
    lengths = huffman.code_lengths(counts)
    book = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(book, "id int, bits int").coalesce(1).write.parquet(f"{folder}/codebook")

    def pack(batches) -> Iterator[pa.RecordBatch]:
        code = huffman.codes(lengths)
        bucket, place, start = None, 0, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            doc_ids, ids, sizes = (np.concatenate(x) for x in zip(*held))
            stream, marks = huffman.encode(ids, lengths, code)
            return batch(
                bucket=pa.array([bucket], pa.int32()), place=pa.array([place], pa.int32()), start=pa.array([start], pa.int64()),
                doc_ids=pa.array([doc_ids.astype("<i8").tobytes()], pa.binary()), counts=pa.array([sizes.astype("<u4").tobytes()], pa.binary()),
                marks=pa.array([marks.astype("<u4").tobytes()], pa.binary()), stream=pa.array([stream], pa.binary()),
            )

        for whole in batches:
            for chunk in chunks(whole, CHUNK):
                ids, at = encoder(tokenizer).encode(chunk.column("text"))
                ids = np.insert(ids, at[1:], np.uint32(end_id))
                at = at + np.arange(len(at))
                sizes = np.diff(at)
                buckets, doc_ids = longs(chunk.column("bucket")), longs(chunk.column("doc_id"))
                i = 0
                while i < len(sizes):
                    if buckets[i] != bucket:
                        if held:
                            yield block()
                            held.clear()
                        bucket, place, start = int(buckets[i]), 0, starts[int(buckets[i])]
                    room = BLOCK_TOKENS - sum(len(h[1]) for h in held)
                    j = min(int(np.searchsorted(buckets, bucket, "right")), max(i + 1, int(np.searchsorted(at, at[i] + room, "right")) - 1))
                    held.append((doc_ids[i:j], ids[at[i] : at[j]], sizes[i:j]))
                    i = j
                    if sum(len(h[1]) for h in held) >= BLOCK_TOKENS or i < len(sizes) and buckets[i] == bucket:
                        yield block()
                        place, start = place + 1, start + sum(len(h[1]) for h in held)
                        held.clear()
        if held:
            yield block()

    ordered_buckets(docs, cuts).select("bucket", "doc_id", "text").mapInArrow(pack, BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of every document."""
    return _decoded(spark, folder, _ids, "ids binary")


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of its ids, decoded from the files."""
    return _decoded(spark, folder, _crcs, "ids_crc32 long")


def _ids(raw: memoryview, ends: np.ndarray) -> dict[str, pa.Array]:
    return {"ids": pa.array([raw[4 * a : 4 * b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())], pa.binary())}


def _crcs(raw: memoryview, ends: np.ndarray) -> dict[str, pa.Array]:
    return {"ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())], pa.int64())}


def _decoded(spark: SparkSession, folder: str, made, column: str) -> DataFrame:
    ship(spark)
    book = spark.read.parquet(f"{folder}/codebook").collect()  # one row for each id of the vocabulary
    lengths = np.zeros(max((r[0] for r in book), default=0) + 1, np.uint8)
    for token, width in book:
        lengths[token] = width

    def unpack(batches) -> Iterator[pa.RecordBatch]:
        table, bits = huffman.decoding_table(lengths)
        for whole in batches:
            for chunk in chunks(whole, CHUNK):
                stream, at = bytes_of(chunk.column("stream"))
                doc_ids, at_docs = bytes_of(chunk.column("doc_ids"))
                sizes, _ = bytes_of(chunk.column("counts"))
                marks, at_marks = bytes_of(chunk.column("marks"))
                doc_ids, sizes, marks = doc_ids.view("<i8"), sizes.view("<u4").astype(np.int64), marks.view("<u4").astype(np.int64)
                n_docs, n_marks = np.diff(at_docs) // 8, np.diff(at_marks) // 4
                ends = np.cumsum(sizes)
                block_end = ends[np.cumsum(n_docs) - 1]
                tokens = np.diff(block_end, prepend=0)
                counts = np.full(len(marks), huffman.MARK_EVERY)
                counts[np.cumsum(n_marks) - 1] = tokens - (n_marks - 1) * huffman.MARK_EVERY
                ids = huffman.decode(stream, marks + np.repeat(at[:-1] * 8, n_marks), counts, table, bits)
                start = ends - sizes + np.repeat(longs(chunk.column("start")) - (block_end - tokens), n_docs)
                yield batch(doc_id=pa.array(doc_ids, pa.int64()), start=pa.array(start, pa.int64()), n_tokens=pa.array(sizes, pa.int64()), **made(memoryview(ids.astype("<u4")).cast("B"), ends))

    return spark.read.parquet(f"{folder}/blocks").mapInArrow(unpack, f"doc_id long, start long, n_tokens long, {column}")
