"""Content-defined chunking, manifests and reassembly."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN, AVERAGE, MAX = 1 << 20, 4 << 20, 16 << 20
_GEAR = np.random.default_rng(1).integers(0, 1 << 63, 256, dtype=np.uint64)


def rolling(data: np.ndarray) -> np.ndarray:
    """The gear hash of the 64 bytes that end at each place, by doubling the window six times."""
    with np.errstate(over="ignore"):
        h, width = _GEAR[data], 1
        while width < 64:
            earlier = np.zeros_like(h)
            earlier[width:] = h[:-width]
            h = h + (earlier << np.uint64(width))
            width *= 2
    return h


def cut_points(data: bytes, least: int = MIN, average: int = AVERAGE, most: int = MAX) -> list[int]:
    """Chunk ends.  A cut is where the rolling hash has enough leading zero bits: two more than
    the average asks for before the average size, two fewer after it; sizes are in [least, most]."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    bits = max(3, average.bit_length() - 1)
    h = rolling(np.frombuffer(data, np.uint8))
    easy = np.flatnonzero((h >> np.uint64(64 - bits + 2)) == 0)
    hard = easy[(h[easy] >> np.uint64(64 - bits - 2)) == 0]
    ends, start = [], 0
    while start < n:
        stop = min(n, start + most)
        if n - start > least:
            i = np.searchsorted(hard, start + least)
            k = np.searchsorted(easy, start + average)
            if i < len(hard) and hard[i] < min(stop, start + average):
                stop = int(hard[i]) + 1
            elif k < len(easy) and easy[k] < stop:
                stop = int(easy[k]) + 1
        ends.append(stop)
        start = stop
    return ends


def chunked(files: DataFrame, least: int = MIN, average: int = AVERAGE, most: int = MAX, with_bytes: bool = True) -> DataFrame:
    """``path, idx, offset, length, hash`` (and ``bytes``) of each chunk of ``files`` (path, content); an empty file has none."""
    schema = "path string, idx long, offset long, length long, hash string" + ", bytes binary" * with_bytes
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = content.as_py() or b""
                ends = cut_points(data, least, average, most)
                starts = [0, *ends[:-1]] if ends else []
                parts = [data[a:b] for a, b in zip(starts, ends, strict=True)]
                tagged = [hashlib.sha256(b"\xed\xf3" + p).hexdigest() for p in parts]
                cols = [pa.array([path] * len(parts), pa.string()), pa.array(range(len(parts)), pa.int64()), pa.array(starts, pa.int64()), pa.array(list(map(len, parts)), pa.int64()), pa.array(tagged, pa.string())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(parts, pa.binary())] * with_bytes, names=names)

    return files.select("path", "content").mapInArrow(run, schema)


def line_chunks(files: DataFrame) -> DataFrame:
    """Newline chunks of ``files`` (path, text): ``path, idx, line, hash``."""
    from treeline.functions.hashing import chunk_hash

    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("idx", "line"))
    return lines.withColumn("hash", chunk_hash(F.encode("line", "UTF-8")))


def manifests(chunks: DataFrame) -> DataFrame:
    """``path, chunk_hashes, n_chunks, is_chunked``: a file of one chunk is stored whole, without a manifest."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda c: c["hash"])
    found = chunks.groupBy("path").agg(ordered.alias("chunk_hashes"))
    return found.withColumn("n_chunks", F.size("chunk_hashes").cast("long")).withColumn("is_chunked", F.col("n_chunks") > 1)


def unseen(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Distinct chunks that the store lacks."""
    return chunks.dropDuplicates(["hash"]).join(stored.select("hash"), "hash", "left_anti")


def reassembled(manifests: DataFrame, chunks: DataFrame) -> DataFrame:
    """``path, content``: the chunks of each manifest in order."""
    asked = manifests.select("path", F.posexplode("chunk_hashes").alias("idx", "hash"))
    bytes_of = chunks.select("hash", "bytes").dropDuplicates(["hash"])
    ordered = F.array_sort(F.collect_list(F.struct("idx", F.hex("bytes").alias("b"))))
    joined = asked.join(bytes_of, "hash").groupBy("path").agg(ordered.alias("parts"))
    return joined.select("path", F.unhex(F.array_join(F.transform("parts", lambda p: p["b"]), "")).alias("content"))
