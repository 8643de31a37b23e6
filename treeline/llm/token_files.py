"""Token-id shard files: frequency-ranked ids in a byte-aligned variable-length code.

A shard holds documents in ascending id order, in blocks.  Ids are replaced by
their corpus-frequency rank (0: most frequent), so that frequent ids take one
byte.  Each value takes 1 to 4 bytes, little-endian; two bits a value, four
values a byte, are kept apart in control bytes.  The reader looks every control
byte up in a 256 x 4 table of lengths and gathers values with numpy alone.

Layout (integers little-endian)::

    shard  = MAGIC  block*  END
    block  = u32 documents, u32 tokens, u32 data bytes, u32 crc32 of the rest
             i64 id * documents, u8 has-id * documents, u32 tokens * documents,
             control bytes, data bytes
    END    = four u32 of 0xFFFFFFFF

``ranks.bin`` beside the shards maps rank to id (u32 each).  A task writes its
shard under a temporary name and moves it, so a repeated task leaves one whole file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeline.llm.shared import shared_dir, slices, staged
from treeline.llm.vocab import Vocabulary
from treeline.llm.wordtable import library_table

MAGIC = b"TLIDS\x00\x01\n"
HEAD = struct.Struct("<4I")
END = b"\xff" * HEAD.size
BLOCK_TOKENS = 1 << 19
#: Lengths of the four values that a control byte describes.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    values = values.astype(np.uint32)
    size = 1 + (values > 0xFF) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    keep = np.arange(4)[None, :] < size[:, None]
    return control.tobytes(), values.astype("<u4").view(np.uint8).reshape(-1, 4)[keep].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of :func:`pack`."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if len(more):
            out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def encoded(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, n, raw)``: each document's ids as zstd-compressed unsigned integers of the least width."""
    wide = _width(Vocabulary(path).size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, squeeze = _encoder(path), pa.Codec("zstd", 3).compress
        for batch in batches:
            for part, text in slices(batch, "text"):
                ids, rows = encode(text)
                raw, cuts = memoryview(ids.astype(wide).tobytes()), (rows * np.dtype(wide).itemsize).tolist()
                packed = [squeeze(raw[a:b], asbytes=True) for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(rows)), pa.array(packed, pa.binary())], names=["id", "n", "raw"])

    plain = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return plain.mapInArrow(run, "id long, n long, raw binary")


def _width(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _unpacked(batch: pa.RecordBatch, wide: str) -> Iterator[np.ndarray]:
    codec, size = pa.Codec("zstd"), np.dtype(wide).itemsize
    for n, raw in zip(batch.column("n").to_pylist(), batch.column("raw"), strict=True):
        yield np.frombuffer(codec.decompress(raw.as_buffer(), n * size, asbytes=True) if n else b"", wide)


def id_frequencies(codes: DataFrame, size: int) -> DataFrame:
    """``(id, n)`` of all ids of :func:`encoded` documents; a task sends one count for each id it met."""
    wide = _width(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, n = np.zeros(size, np.int64), [], 0
        for batch in batches:
            for ids in _unpacked(batch, wide):
                held.append(ids)
                n += len(ids)
                if n > 1 << 20:
                    counts += np.bincount(np.concatenate(held), minlength=size)
                    held, n = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=size)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met])], names=["id", "n"])

    return codes.select("n", "raw").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _encoder(path: str):
    table = library_table(path)
    if table is not None:
        return table.encode
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)

    def encode(text: pa.Array):
        found = [e.ids for e in library.encode_batch_fast([t.decode() for t in text.to_pylist()], add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.uint32), np.concatenate([[0], np.cumsum([len(ids) for ids in found])]).astype(np.int64)

    return encode


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int, shards: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode all texts into shard files under ``folder``, in ascending id order.

    Null text counts as empty, a null id comes first and repeated ids follow each
    other; ``end_id`` ends each document.  Returns the manifest ``(shard, file, n_docs,
    n_tokens, base)``, ``base`` being the tokens of all shards before.  One small file of
    ranks (bounded by the vocabulary) is made on the driver.
    """
    spark = docs.sparkSession
    size = Vocabulary(path).size
    wide = _width(size)
    codes = staged(encoded(docs, path, id_column, text_column), "encoded")  # texts are encoded once
    counts = dict(id_frequencies(codes, size).collect())  # one row for each id of the vocabulary at most
    top = max([end_id, *counts]) + 1
    n_docs = codes.count()
    counts[end_id] = counts.get(end_id, 0) + n_docs
    by_rank = np.array(sorted(range(top), key=lambda i: (-counts.get(i, 0), i)), np.uint32)
    rank_of = np.empty(top, np.uint32)
    rank_of[by_rank] = np.arange(top, dtype=np.uint32)
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/ranks.bin") as out:
        out.write(by_rank.astype("<u4").tobytes())
    held = spark.sparkContext.broadcast(rank_of)  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        rank = held.value
        files, base = fs.FileSystem.from_uri(folder)
        name, hidden = f"{base}/shard-{shard:06d}.ids", f"{base}/.{uuid.uuid4().hex}"
        docs_in = tokens_in = 0
        with files.open_output_stream(hidden) as out:
            out.write(MAGIC)
            for ids, values in _grouped(batches, wide):
                sizes = np.array([len(v) + 1 for v in values], np.int64)
                ranked = np.full(int(sizes.sum()), rank[end_id], np.uint32)
                keep = np.ones(len(ranked), bool)
                keep[np.cumsum(sizes) - 1] = False
                ranked[keep] = rank[np.concatenate(values)]
                out.write(_block(pa.array(ids, pa.int64()), sizes, ranked))
                docs_in, tokens_in = docs_in + len(sizes), tokens_in + len(ranked)
            out.write(END)
        files.move(hidden, name)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (shard, name.rsplit("/", 1)[1], docs_in, tokens_in)], names=["shard", "file", "n_docs", "n_tokens"])

    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = codes.repartitionByRange(shards, "id").sortWithinPartitions("id", "n")
    manifest = staged(ordered.mapInArrow(run, "shard long, file string, n_docs long, n_tokens long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _grouped(batches: Iterator[pa.RecordBatch], wide: str) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(ids, their token ids) of about ``BLOCK_TOKENS`` tokens at a time."""
    ids, values, n = [], [], 0
    for batch in batches:
        for i, v in zip(batch.column("id").to_pylist(), _unpacked(batch, wide), strict=True):
            ids.append(i)
            values.append(v)
            n += len(v) + 1
            if n >= BLOCK_TOKENS:
                yield ids, values
                ids, values, n = [], [], 0
    if ids:
        yield ids, values


def _block(ids: pa.Array, sizes: np.ndarray, values: np.ndarray) -> bytes:
    control, data = pack(values)
    has = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
    body = ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes() + has.tobytes() + sizes.astype("<u4").tobytes() + control + data
    return HEAD.pack(len(sizes), len(values), len(data), zlib.crc32(body)) + body


def read_blocks(stream) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, has id, tokens of each document, ranks) of each block of a shard; ValueError on damage."""
    if stream.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token-id shard")
    while True:
        head = stream.read(HEAD.size)
        if head == END:
            return
        if len(head) < HEAD.size:
            raise ValueError("the shard is cut off")
        n, tokens, size, crc = HEAD.unpack(head)
        n_control = -(-tokens // 4)
        body = stream.read(13 * n + n_control + size)
        if zlib.crc32(body) != crc:
            raise ValueError("a block's checksum differs")
        control, data = body[13 * n : 13 * n + n_control], body[13 * n + n_control :]
        yield np.frombuffer(body, "<i8", n), np.frombuffer(body, np.uint8, n, 8 * n) > 0, np.frombuffer(body, "<u4", n, 9 * n).astype(np.int64), unpack(control, data, tokens)


def read_token_files(manifest: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and, unless switched off, ``ids`` of each document."""
    spark = manifest.sparkSession
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        with files.open_input_stream(f"{root}/ranks.bin") as ranks:
            by_rank = np.frombuffer(ranks.read(), "<u4")
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with files.open_input_stream(f"{root}/{file}") as stream:
                    for ids, has, sizes, ranked in read_blocks(stream):
                        tokens = by_rank[ranked]
                        cuts = np.concatenate([[0], np.cumsum(sizes)])
                        raw = memoryview(tokens.astype("<u4").tobytes())
                        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
                        cols = [pa.array(ids, mask=~has), pa.array(base + cuts[:-1]), pa.array(sizes), pa.array(crc, pa.int64())]
                        if with_ids:
                            cols.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(tokens.astype(np.int32))))
                        yield pa.RecordBatch.from_arrays(cols, names=names)
                        base += int(cuts[-1])

    shards = max(1, min(manifest.count(), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return manifest.select("file", "base").repartition(shards).mapInArrow(run, schema)


def token_files(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write all of ``docs`` to shard files in the shared folder and read their digests back."""
    folder = shared_dir(docs.sparkSession, "token-ids")
    manifest = write_token_files(docs, path, folder, end_id)
    return read_token_files(manifest, folder, with_ids=False)
