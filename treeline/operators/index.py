"""Object index: membership, tiers, compaction, packing and Bloom filters.

Entries have ``hash, kind, length`` and, where needed, ``generation, pack, offset``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeline.functions.hashing import bloom_bits, hash_prefix, optimal_bits

PACK_TARGET, SMALL_PACK = 4 << 20, 2 << 20


def put_new(objects: DataFrame, existing: DataFrame) -> DataFrame:
    """Idempotent put: one row for each hash that the store lacks."""
    return objects.dropDuplicates(["hash"]).join(existing.select("hash"), "hash", "left_anti")


def present(wanted: DataFrame, index: DataFrame) -> DataFrame:
    return wanted.join(index.select("hash"), "hash", "left_semi")


def missing(wanted: DataFrame, index: DataFrame) -> DataFrame:
    return wanted.join(index.select("hash"), "hash", "left_anti")


def latest_entries(entries: DataFrame, order: list[Column | str] | None = None) -> DataFrame:
    """One entry for each hash: that of the newest generation, ties by the given order (largest wins)."""
    rest = [c for c in entries.columns if c != "hash"]
    rank = F.struct("generation", *(order or []))
    return entries.groupBy("hash").agg(F.max_by(F.struct(*rest), rank).alias("e")).select("hash", "e.*")


def locate(wanted: DataFrame, tiers: DataFrame) -> DataFrame:
    """Each wanted hash with the entry of the first tier that holds it (``tier``: smaller first), or nulls."""
    rest = [c for c in tiers.columns if c != "hash"]
    first = tiers.groupBy("hash").agg(F.min_by(F.struct(*rest), F.struct("tier", *[c for c in rest if c != "tier"])).alias("e")).select("hash", "e.*")
    return wanted.select("hash").distinct().join(first, "hash", "left")


def hot_and_cold(entries: DataFrame, reachable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reachable or standalone entries, the rest)."""
    marked = entries.join(reachable.select("hash", F.lit(True).alias("_hot")).dropDuplicates(["hash"]), "hash", "left")
    hot = F.coalesce("_hot", F.lit(False)) | (F.col("kind") == "standalone")
    return marked.where(hot).drop("_hot"), marked.where(~hot).drop("_hot")


def shard_of(hex_hash: Column, bits: int) -> Column:
    return hash_prefix(hex_hash, bits)


def add_to_shards(cold: DataFrame, new: DataFrame, bits: int) -> DataFrame:
    """Cold entries with their shard after an append: each entry joins the shard of its own prefix."""
    return latest_entries(cold.unionByName(new)).withColumn("shard", shard_of(F.col("hash"), bits))


def crowded_byte(entries: DataFrame) -> DataFrame:
    """The most frequent first byte of the hashes; the least one of equals."""
    return entries.groupBy(F.substring("hash", 1, 2).alias("byte")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "byte").limit(1)


def split_shard(shards: DataFrame, entry_bytes: int, limit: int = PACK_TARGET) -> DataFrame:
    """The entries that leave the largest shard over ``limit`` bytes for one of their own: its most frequent first byte."""
    sizes = shards.groupBy("shard").agg((F.count("*") * entry_bytes).alias("bytes")).where(F.col("bytes") > limit).orderBy(F.desc("bytes"), "shard").limit(1)
    inside = shards.join(F.broadcast(sizes.select("shard")), "shard")  # one row
    return inside.join(F.broadcast(crowded_byte(inside).select("byte")), F.substring("hash", 1, 2) == F.col("byte"))  # one row


def packed(objects: DataFrame, group: str, order: str, target: int = PACK_TARGET) -> DataFrame:
    """``objects`` with ``pack_no, offset``: a pack is flushed when it has ``target`` bytes or more.

    A fold with resets, streamed through rows sorted by ``group`` (a writer) and ``order``; no
    group is gathered.
    """
    schema = objects.schema.simpleString()[7:-1] + ",pack_no:bigint,offset:bigint"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, number, filled = None, 0, 0
        for rows in batches:
            numbers, offsets = [], []
            for key, length in zip(rows[group], rows["length"], strict=True):
                if key != at:
                    at, number, filled = key, 0, 0
                elif filled >= target:
                    number, filled = number + 1, 0
                numbers.append(number)
                offsets.append(filled)
                filled += length
            yield rows.assign(pack_no=numbers, offset=offsets)

    return objects.repartition(group).sortWithinPartitions(group, order).mapInPandas(fold, schema)


def small_packs(entries: DataFrame, limit: int = SMALL_PACK) -> DataFrame:
    """Packs under ``limit`` bytes, to be consolidated."""
    return entries.where("kind = 'pack'").groupBy("pack").agg(F.sum("length").alias("bytes"), F.count("*").alias("entries")).where(F.col("bytes") < limit)


def resolve(entries: DataFrame, packs: DataFrame) -> DataFrame:
    """``hash, bytes``: inline data, or the slice of the pack (after its two-byte tag); null for standalone objects."""
    joined = entries.join(packs.select(F.col("pack_hash"), F.col("bytes").alias("_pack")), "pack_hash", "left")
    part = F.expr("substring(_pack, cast(3 + offset as int), cast(length as int))")
    return joined.select("hash", F.when(F.col("kind") == "inline", F.col("data")).when(F.col("kind") == "pack", part).alias("bytes"))


def _bloom_words(bits: DataFrame) -> DataFrame:
    """``word, bits``: the column ``bit`` as words of 64 bits; a task sends no more rows than the filter has words."""
    word, at = F.shiftright("bit", 6).alias("word"), F.col("bit").bitwiseAND(F.lit(63)).cast("int").alias("at")
    return bits.where("bit is not null").select(word, at).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, at))").alias("bits"))


def bloom_table(entries: DataFrame, n: int = 100_000, p: float = 0.01, k: int = 7) -> DataFrame:
    """The set bits of a Bloom filter over the entries' hashes, as an exact table; repeated hashes do no harm."""
    asked = entries.select(bloom_bits(F.col("hash"), optimal_bits(n, p), k).alias("_bits"))  # apart, so that parts are computed once
    words = _bloom_words(asked.select(F.explode("_bits").alias("bit")))
    places = F.filter(F.sequence(F.lit(0).cast("bigint"), F.lit(63).cast("bigint")), lambda i: F.getbit("bits", i.cast("int")) == 1)
    return words.select("word", F.explode(places).alias("at")).select((F.col("word") * 64 + F.col("at")).alias("bit"))


def bloom_fill(bits: DataFrame, m: int) -> DataFrame:
    return bits.agg(F.count("*").alias("set_bits"), F.round(F.count("*") / F.lit(m), 6).alias("fill"))


def may_contain(wanted: DataFrame, bits: DataFrame, n: int = 100_000, p: float = 0.01, k: int = 7) -> DataFrame:
    """The wanted hashes all of whose bits are set, row by row; every inserted hash is among them.

    The filter is broadcast as one array of words and tested in place: no wanted hash is shuffled.
    """
    m = optimal_bits(n, p)
    words = bits.sparkSession.range(0, (m + 63) // 64, 1, 1).withColumnRenamed("id", "word").join(_bloom_words(bits), "word", "left")
    whole = words.agg(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits")))).alias("words")).select(F.col("words.bits").alias("_words"))
    asked = wanted.select("hash", bloom_bits(F.col("hash"), m, k).alias("_bits")).join(F.broadcast(whole))  # one row of m bits
    bit = [F.get("_bits", F.lit(i)) for i in range(k)]
    held = [F.getbit(F.get("_words", F.shiftright(b, 6).cast("int")), b.bitwiseAND(F.lit(63)).cast("int")) == 1 for b in bit]
    return asked.where(reduce(Column.__and__, held)).select("hash")


def hash_by_prefix(entries: DataFrame, prefix: str) -> DataFrame:
    """Distinct hashes with a prefix of four digits at least, in order; more than one means it is ambiguous."""
    if len(prefix) < 4:
        raise ValueError("a hash prefix needs four digits at least")
    return entries.where(F.col("hash").startswith(prefix.lower())).select("hash").distinct().orderBy("hash")


def compact(entries: DataFrame, reachable: DataFrame, order: list[str]) -> dict[str, DataFrame]:
    """Merged hot and cold entries, packs to consolidate and metrics of one compaction."""
    merged = latest_entries(entries, order)
    hot, cold = hot_and_cold(merged, reachable)
    metrics = merged.join(hot.select("hash", F.lit(1).alias("_h")), "hash", "left").agg(F.count("*").alias("merged_entries"), F.count("_h").alias("hot_index_entries"), (F.count("*") - F.count("_h")).alias("cold_entries"))
    return {"hot": hot, "cold": cold, "small_packs": small_packs(hot), "metrics": metrics}


def in_order(entries: DataFrame, partitions: int) -> DataFrame:
    """Entries sorted by hash over files, for range pruning and merge joins."""
    return entries.repartitionByRange(partitions, "hash").sortWithinPartitions("hash")


def running_offsets(objects: DataFrame, group: str, order: str) -> DataFrame:
    """The offset of each object in its group's byte stream."""
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return objects.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def superseded_bytes(entries: DataFrame, order: list[str]) -> DataFrame:
    """Bytes of entries that a newer generation replaced, and the entries' count."""
    kept = latest_entries(entries, order).agg(F.count("*").alias("kept"), F.sum("length").alias("kept_bytes"))
    everything = entries.agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))
    both = everything.withColumn("_k", F.lit(1)).join(kept.withColumn("_k", F.lit(1)), "_k")  # one row each
    return both.select((F.col("n") - F.col("kept")).alias("superseded"), (F.col("bytes") - F.col("kept_bytes")).alias("superseded_bytes"))


def pack_sizes(packed_objects: DataFrame, group: str) -> DataFrame:
    """Packs written by each writer: their number and sizes in order."""
    packs = packed_objects.groupBy(group, "pack_no").agg(F.sum("length").alias("bytes"))
    sizes = F.transform(F.array_sort(F.collect_list(F.struct("pack_no", "bytes"))), lambda p: p["bytes"])
    return packs.groupBy(group).agg(F.count("*").alias("packs"), sizes.alias("sizes"))
