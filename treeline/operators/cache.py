"""Stat cache: hits, base fallback, stable times, refresh and scoped merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions.paths import in_scope
from treeline.operators.diff import overlay

RACY_SECONDS = 3


def is_racy(mtime_secs: Column, now: Column | int) -> Column:
    """Changed less than three seconds ago: a later change could keep the time."""
    return (F.lit(now) if isinstance(now, int) else now) - mtime_secs < RACY_SECONDS


def cache_hits(files: DataFrame, cache: DataFrame) -> DataFrame:
    """``files`` (path, size, mtime_secs, mtime_nanos) with the cached hash where path, size and time agree and the row is safe."""
    safe = cache.where("not is_unsafe").select("path", F.col("fs_size").alias("size"), "mtime_secs", "mtime_nanos", F.col("hash").alias("cached_hash"))
    return files.join(safe, ["path", "size", "mtime_secs", "mtime_nanos"], "left")


def can_skip_hash(now: int) -> Column:
    """The base has the path as a blob of the same size and whole time, and the time is old enough."""
    same = (F.col("base_kind") == "blob") & (F.col("base_size") == F.col("size")) & (F.col("base_mtime_secs") == F.col("mtime_secs")) & (F.col("base_mtime_nanos") == F.col("mtime_nanos"))
    return F.coalesce(same & ~is_racy(F.col("mtime_secs"), now), F.lit(False))


def hash_source(files: DataFrame, cache: DataFrame, base: DataFrame, now: int) -> DataFrame:
    """``path, source, hash``: from the cache, else from the base, else to be read (null hash).

    ``base`` without ``kind`` has blobs only, without ``mtime_nanos`` whole seconds.
    """
    kind = F.col("kind") if "kind" in base.columns else F.lit("blob")
    nanos = F.col("mtime_nanos") if "mtime_nanos" in base.columns else F.lit(0)
    known = base.select("path", kind.alias("base_kind"), F.col("size").alias("base_size"), F.col("mtime_secs").alias("base_mtime_secs"), nanos.alias("base_mtime_nanos"), F.col("hash").alias("base_hash"))
    joined = cache_hits(files, cache).join(known, "path", "left")
    source = F.when(F.col("cached_hash").isNotNull(), "cache").when(can_skip_hash(now), "base").otherwise("read")
    return joined.select("path", source.alias("source"), F.when(source == "cache", F.col("cached_hash")).when(source == "base", F.col("base_hash")).alias("hash"))


def stable_times(files: DataFrame, base: DataFrame) -> DataFrame:
    """Unchanged content keeps the base's time."""
    known = base.select("path", F.col("hash").alias("base_hash"), F.col("mtime_secs").alias("base_mtime"))
    joined = files.join(known, "path", "left")
    return joined.withColumn("mtime_secs", F.when(F.col("hash") == F.col("base_hash"), F.col("base_mtime")).otherwise(F.col("mtime_secs"))).drop("base_hash", "base_mtime")


def preserve_unstable(files: DataFrame, unstable: DataFrame, base: DataFrame) -> DataFrame:
    """Files that changed while they were read keep their base entry, or drop out without one."""
    steady = files.join(unstable.select("path"), "path", "left_anti")
    return steady.unionByName(base.join(unstable.select("path"), "path", "left_semi").select(*files.columns))


def refreshed(scanned: DataFrame, now: int) -> DataFrame:
    """Cache rows of scanned files that were hashed or taken from the base (hits are in the cache already)."""
    fresh = scanned.where("not cache_hit")
    return fresh.select("path", "mtime_secs", "mtime_nanos", F.col("size").alias("fs_size"), "hash", is_racy(F.col("mtime_secs"), now).alias("is_unsafe"))


def merge_scope(cache: DataFrame, rows: DataFrame, scope: str) -> DataFrame:
    """The cache after a scan of ``scope``: its rows are replaced, others stay."""
    outside = cache.where(~in_scope(F.col("path"), [scope]))
    return overlay(rows, outside)


def upsert(cache: DataFrame, rows: DataFrame) -> DataFrame:
    return overlay(rows, cache)


def needs_write(cache: DataFrame, rows: DataFrame) -> bool:
    """Whether any row is new or differs (the cache is written only then)."""
    return not rows.exceptAll(cache.select(*rows.columns)).isEmpty()
