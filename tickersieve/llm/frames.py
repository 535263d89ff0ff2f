"""Shared pieces of the corpus operators: stored tables, Arrow batches, shipping of this package."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20  # of text that one step of a task holds at once; a longer text is a chunk alone

_shipped: set[str] = set()
_own_folder: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers where the cluster's PYTHONPATH lacks it."""
    root = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    known = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if app in _shipped or root in known:
        return
    _shipped.add(app)
    archive = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / "package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.joinpath(Path(__file__).resolve().parents[1].name).rglob("*.py")):
            out.write(file, file.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own_folder[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh folder that is deleted when the session's file system is closed."""
    path = f"{shared_dir(spark)}/llm-{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table once and read it back; lost executors cannot force a recomputation."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by `written` that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/llm-" in f}:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of jobs that are over; it acts on garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def map_arrow(df: DataFrame, step: Callable[..., Iterator[pa.RecordBatch]], schema: str, **bound) -> DataFrame:
    """mapInArrow over chunks of at most CHUNK_BYTES of text, with `bound` given to each step."""
    ship(df.sparkSession)

    def task(batches):
        for batch in batches:
            for chunk in chunks(batch):
                yield from step(chunk, **bound)

    return df.mapInArrow(task, schema)


def chunks(batch: pa.RecordBatch, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose variable-length columns hold about `limit` bytes."""
    if not batch.num_rows:
        return
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            sizes += np.diff(offsets_of(column))
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def offsets_of(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary column (null: empty) end to end, and each row's offsets in them."""
    if column.null_count:
        column = column.fill_null("" if "string" in str(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = offsets_of(column)
    data = column.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0])), offsets - offsets[0]


def longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def batch(**columns) -> pa.RecordBatch:
    arrays = {k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()}
    return pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))


def documents(df: DataFrame, *extra: str) -> DataFrame:
    """doc_id as long and text as string, by name; other columns of the input don't matter.

    Rows without a doc_id cannot be named in a result and are left out."""
    columns: list[Column] = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    return df.select(*columns, *extra).where(F.col("doc_id").isNotNull())


def range_cuts(docs: DataFrame, parts: int) -> list[int]:
    """At most `parts` - 1 ascending numbers that cut the doc_ids into ranges of about equal counts."""
    if parts < 2:
        return []
    found = docs.select("doc_id").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)
    return sorted({int(c) for c in found})


def with_bucket(docs: DataFrame, cuts: list[int]) -> DataFrame:
    """Adds `bucket`: the number of cuts up to doc_id."""
    if not cuts:
        return docs.withColumn("bucket", F.lit(0))
    edges = F.array(*[F.lit(c).cast("long") for c in cuts])
    above = F.aggregate(edges, F.lit(0), lambda n, e: n + F.when(F.col("doc_id") >= e, 1).otherwise(0))
    return docs.withColumn("bucket", above.cast("int"))


def ordered_buckets(docs: DataFrame, cuts: list[int], lookahead: bool = False) -> DataFrame:
    """Documents dealt out by ranges of doc_id, each range in one task and sorted.

    Adds `bucket` (ascending with doc_id) and, with `lookahead`, repeats the first document of each
    bucket at the end of the one before (of the first at the end of the last) with `ahead` true.
    Only one number for each bucket reaches the driver.
    """
    docs = with_bucket(docs, cuts)
    keys = ["bucket", "doc_id", "text"]
    if lookahead:
        spark = docs.sparkSession
        firsts = sorted(tuple(r) for r in docs.groupBy("bucket").agg(F.min("doc_id")).collect())
        own = docs.withColumn("ahead", F.lit(False))
        docs = own
        if firsts:
            before = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
            to = F.broadcast(spark.createDataFrame(before, "doc_id long, to_bucket int"))
            again = own.join(to, "doc_id").withColumns({"bucket": F.col("to_bucket"), "ahead": F.lit(True)})
            docs = own.unionByName(again.select(own.columns))
        keys.insert(1, "ahead")
    return docs.repartitionByRange(len(cuts) + 1, "bucket").sortWithinPartitions(*keys)


def parts_for(df: DataFrame) -> int:
    """As many range buckets as a shuffle of this session has partitions."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
