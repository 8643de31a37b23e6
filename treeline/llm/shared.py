"""Shared-folder staging and Arrow slicing used by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker expands into numpy arrays at a time.
SLICE_BYTES = 2 << 20
#: A key of a join is hot with more than one in so many of all rows.
HOT = 1024


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new, unused path in the folder that the driver and all executors share.

    The folder is ``spark.checkpoint.dir``.  Only a local master without that
    setting gets a temporary folder; on a cluster a missing setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="treeline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def beside(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with the row of ``facts`` for their ``key``; ``facts`` has each key once and counts its rows in ``n``.

    Keys of more than one in ``HOT`` of the rows counted, which are fewer than ``HOT``, are broadcast: their rows stay
    where they are, and no task of the shuffled rest gets more rows of one key than that.  If all keys are hot, or none
    is, there is one join: plans of many joins take the driver's memory.
    """
    facts = staged(facts, "facts")
    total, low, high = facts.agg(F.sum("n"), F.min("n"), F.max("n")).first()
    most = (total or 0) / HOT
    if total is None or high <= most:
        return rows.join(facts, key)
    if low > most:
        return rows.join(F.broadcast(facts), key)
    hot = facts.where(F.col("n") > most)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(facts.where(F.col("n") <= most), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a staged folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def filled(column: pa.Array) -> pa.Array:
    """A string or binary column as binary with 32-bit offsets; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.binary())
    return column.fill_null(b"") if column.null_count else column


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows back to back, offsets of the rows) of a binary column without nulls."""
    n, shift = len(column), column.offset
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[shift : shift + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Zero-copy row ranges of ``batch`` of about ``limit`` bytes of ``column`` (one row at least)."""
    if not batch.num_rows:
        return
    text = filled(batch.column(column))
    ends = flat(text)[1][1:]
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start), text.slice(start, stop - start)
        start = stop


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenation of the ranges [start, start + length)."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` within each range of ``offsets`` (0 for an empty one)."""
    running = np.concatenate([[0], np.cumsum(values)])
    return running[offsets[1:]] - running[offsets[:-1]]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public-domain splitmix64 constants) over an array of hashes."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def vector_rows(vector: np.ndarray, segments: int = 64) -> pa.RecordBatch:
    """A vector of doubles cut into rows ``(segment, v)`` for :func:`added_vectors`."""
    parts = np.array_split(vector.astype("<f8"), segments)
    return pa.RecordBatch.from_arrays([pa.array(range(segments), pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["segment", "v"])


def added_vectors(rows: DataFrame) -> np.ndarray | None:
    """The sum of all vectors that were cut by :func:`vector_rows`; None if there were none.

    Segments are added on the executors, so the driver gets one vector however many tasks there were.
    """
    from collections.abc import Iterator

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            for raw in batch.column("v").to_pylist():
                total = total + np.frombuffer(raw, "<f8")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([total.astype("<f8").tobytes()])], names=["segment", "v"])

    add.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    parts = rows.groupBy("segment").applyInArrow(add, "segment long, v binary").collect()
    return np.concatenate([np.frombuffer(p.v, "<f8") for p in sorted(parts, key=lambda p: p.segment)]) if parts else None
