"""Content classification: size buckets, content types, object kinds, compression methods."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower bounds and labels of the size histogram.
BUCKETS = [
    (0, "<256B"), (256, "256B-1KB"), (1024, "1-4KB"), (4096, "4-16KB"), (16384, "16-64KB"),
    (65536, "64-256KB"), (262144, "256KB-1MB"), (1048576, "1-4MB"), (4194304, "4-16MB"), (16777216, ">16MB"),
]
# Leading bytes (hex) of content types, first match wins.
MAGIC = [("FFD8FF", "jpeg"), ("89504E470D0A1A0A", "png"), ("47494638", "gif"), ("52494646........57454250", "webp"), ("25504446", "pdf"), ("504B0304", "zip"), ("1F8B", "gzip"), ("28B52FFD", "zstd"), ("78(01|5E|9C|DA)", "zlib")]
# Leading bytes (hex) of stored objects by compression method.
METHODS = {"EDDE": "dict_zstd", "EDDF": "plain_zstd", "EDD0": "escaped_raw"}
SAMPLE = 1024


def bucket_index(size: Column) -> Column:
    found = F.lit(0)
    for i, (low, _) in enumerate(BUCKETS[1:], 1):
        found = F.when(size >= low, i).otherwise(found)
    return found


def bucket_label(index: Column) -> Column:
    return F.get(F.array(*[F.lit(label) for _, label in BUCKETS]), index)


def content_type(content: Column) -> Column:
    """Type by leading bytes; else text if the first 1024 bytes are UTF-8 without control bytes, else binary."""
    head = F.hex(F.substring(content, 1, 12))
    sample = F.substring(content, 1, SAMPLE)
    control = F.hex(sample).rlike("^(?:..)*?(?:0[0-8]|0[EF]|1[0-9A-F])")
    found = F.when(F.is_valid_utf8(sample.cast("string")) & ~control, "text").otherwise("binary")
    for pattern, name in reversed(MAGIC):
        pattern = pattern.replace("........", "(?:..){4}")
        found = F.when(head.rlike(f"^{pattern}"), name).otherwise(found)
    return found


def object_kind(stored: Column) -> Column:
    """tree, blob, manifest, chunk or unknown (index-layer objects) by leading bytes."""
    head = F.hex(F.substring(stored, 1, 2))
    return F.when(head == "EDF1", "tree").when(head == "EDF2", "manifest").when(head == "EDF3", "chunk").when(head.rlike("^EDE[1-9A-F]$"), "unknown").otherwise("blob")


def compression(stored: Column) -> Column:
    """How stored bytes are compressed, by their two leading bytes; without a tag they are raw."""
    found = F.lit("raw")
    for lead, name in METHODS.items():
        found = F.when(F.hex(F.substring(stored, 1, 2)) == lead, name).otherwise(found)
    return found


def decoded(stored: Column) -> Column:
    """The bytes before compression: raw and escaped ones in place, plain zstd frames by Arrow batches.

    Unsound frames and frames that need a dictionary give null.
    """
    method, rest = compression(stored), F.substring(stored, 3, 2147483647)
    return F.when(method == "raw", stored).when(method == "escaped_raw", rest).when(method == "plain_zstd", _inflated(F.when(method == "plain_zstd", rest)))


def _inflated(frames: Column) -> Column:
    @F.pandas_udf("binary")
    def run(column: pd.Series) -> pd.Series:
        import zstandard

        def one(frame: bytes | None) -> bytes | None:
            try:
                return None if frame is None else zstandard.ZstdDecompressor().decompressobj().decompress(frame)
            except zstandard.ZstdError:
                return None

        return column.map(one)

    return run(frames)


def route(size: Column) -> Column:
    """Where an encoded object goes: inline, pack or standalone."""
    return F.when(size < 256, "inline").when(size < 1048576, "pack").otherwise("standalone")
