"""Writers: sorted caches and index files, object stores, stub records, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.operators.cache import needs_write
from treeline.operators.index import in_order, put_new


def write_sorted(rows: DataFrame, path: str, key: str = "path", partitions: int = 1) -> None:
    """Parquet sorted by ``key`` over all files, so that row groups are pruned by ranges of it."""
    rows.repartitionByRange(partitions, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def write_cache_if_dirty(cache: DataFrame, rows: DataFrame, path: str) -> bool:
    """Writes the merged cache only if a row is new or changed; tells whether it did."""
    from treeline.operators.cache import upsert

    if not needs_write(cache, rows):
        return False
    write_sorted(upsert(cache, rows), path)
    return True


def put_objects(objects: DataFrame, existing: DataFrame, path: str) -> None:
    """Appends the objects that the store lacks, once each."""
    put_new(objects, existing).write.mode("append").parquet(path)


def write_index(entries: DataFrame, path: str, partitions: int = 1) -> None:
    in_order(entries, partitions).write.mode("overwrite").parquet(path)


def write_stubs(stubs: DataFrame, path: str) -> None:
    """Stub records as JSON lines, null fields left out."""
    stubs.write.mode("append").option("ignoreNullFields", "true").json(path)


def append_io_record(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def write_report(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)
