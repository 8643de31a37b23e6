"""Storage statistics: histograms, size and compression totals, storage classes, I/O history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeline.functions.content import bucket_index, bucket_label, compression, content_type, decoded, object_kind
from treeline.functions.hashing import unescape_standalone
from treeline.sources.staging import cut


def size_histogram(sizes: DataFrame, size: str = "size") -> DataFrame:
    """``bucket, label, count, bytes, count_pct, bytes_pct`` of the buckets that hold a size.

    Shares are taken of at most ten rows; they are 0 when all sizes are 0.
    """
    buckets = sizes.groupBy(bucket_index(F.col(size)).alias("bucket")).agg(F.count("*").alias("count"), F.sum(size).alias("bytes"))
    share = lambda c: F.coalesce(F.try_divide(F.col(c) * 100.0, F.sum(c).over(Window.partitionBy())), F.lit(0.0))
    return buckets.select("bucket", bucket_label(F.col("bucket")).alias("label"), "count", "bytes", share("count").alias("count_pct"), share("bytes").alias("bytes_pct"))


def size_stats(objects: DataFrame, *keys: str) -> DataFrame:
    """Count, stored and logical totals, least, greatest and mean stored size, and the ratio in percent (null: nothing logical)."""
    totals = objects.groupBy(*keys).agg(
        F.count("*").alias("count"), F.coalesce(F.sum("stored"), F.lit(0)).alias("stored"), F.coalesce(F.sum("logical"), F.lit(0)).alias("logical"),
        F.min("stored").alias("min_stored"), F.max("stored").alias("max_stored"), F.coalesce(F.avg("stored"), F.lit(0.0)).alias("avg_stored"),
    )
    ratio = F.try_divide(F.col("stored") * 100.0, F.col("logical"))
    return totals.withColumn("ratio_pct", ratio).withColumn("saved_pct", 100 - ratio)


def classified(objects: DataFrame, content: str = "content", plain: str | None = None) -> DataFrame:
    """``objects`` with ``kind, method, content_type``; the content type of blobs only.

    The method is told from the stored bytes, kind and type from those before compression: the column
    ``plain`` where they are known, else they are decoded.  What can't be decoded is of unknown kind.
    """
    inner = unescape_standalone(F.col(content))
    before = decoded(inner) if plain is None else F.col(plain)
    kind = F.when(before.isNull(), "unknown").otherwise(object_kind(before))
    return objects.withColumns({"kind": kind, "method": F.when((kind != "unknown") | before.isNull(), compression(inner)), "content_type": F.when(kind == "blob", content_type(before))})


def kind_totals(objects: DataFrame) -> DataFrame:
    return objects.groupBy("kind").agg(F.count("*").alias("count"), F.sum("stored").alias("stored"))


def method_totals(objects: DataFrame) -> DataFrame:
    return objects.where("method is not null").groupBy("method").agg(F.count("*").alias("count"), F.sum("stored").alias("stored"))


def content_type_totals(objects: DataFrame) -> DataFrame:
    """By content type, most frequent first, equal counts by name."""
    totals = size_stats(objects.where("content_type is not null"), "content_type")
    return totals.orderBy(F.desc("count"), "content_type")


def classify_listing(listing: DataFrame, known: DataFrame) -> DataFrame:
    """``listing`` (key, size) with the class of the first known set that holds the key, else orphan.

    ``known`` has ``key, class, priority``.
    """
    first = known.groupBy("key").agg(F.min_by("class", "priority").alias("class"))
    return listing.join(first, "key", "left").withColumn("class", F.coalesce("class", F.lit("orphan")))


def class_totals(classified_listing: DataFrame) -> DataFrame:
    """By storage class, and ``total``."""
    return classified_listing.rollup("class").agg(F.count("*").alias("count"), F.sum("size").alias("bytes")).select(F.coalesce("class", F.lit("total")).alias("class"), "count", "bytes")


def live_and_reclaimable(classified_listing: DataFrame) -> DataFrame:
    orphan = F.coalesce(F.sum(F.when(F.col("class") == "orphan", F.col("size"))), F.lit(0))
    return classified_listing.agg(F.greatest(F.sum("size") - orphan, F.lit(0)).alias("live"), orphan.alias("reclaimable"))


IO_COUNTERS = ("exists_found", "exists_miss", "writes", "write_bytes", "reads", "read_bytes")


def io_totals(records: DataFrame, *keys: str) -> DataFrame:
    return records.groupBy(*keys).agg(F.count("*").alias("runs"), *[F.sum(c).alias(c) for c in IO_COUNTERS])


def latest_detail(records: DataFrame) -> DataFrame:
    """The newest record with a compaction detail."""
    found = records.where("pack_detail is not null").agg(F.max("line_no").alias("line_no"), F.max_by("pack_detail", "line_no").alias("d"))
    return found.where("line_no is not null").select("line_no", "d.*")


def recent(records: DataFrame, n: int) -> DataFrame:
    """The last ``n`` records by time, then line."""
    return records.orderBy(F.desc("ts"), F.desc("line_no")).limit(n)


def nth_newest(records: DataFrame, n: int) -> DataFrame:
    """The ``n``-th newest record (1: newest); empty when out of range."""
    return records.orderBy(F.desc("ts"), F.desc("line_no")).limit(n).orderBy("ts", "line_no").limit(1).where(F.lit(n) <= records.limit(n).count())


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``rank`` (from 1) in a total order over all partitions.

    Rows are range-partitioned and sorted, and cut there; a rank is the place in the partition plus
    the sizes of those before (one number for each partition comes to the driver).
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).cast("int")
    sizes = dict(placed.groupBy(part.alias("part")).count().collect())
    before = [0]
    for k in range(max(sizes, default=0)):
        before.append(before[-1] + sizes.get(k, 0))
    starts = F.array(*[F.lit(x).cast("long") for x in before])
    return placed.withColumn("rank", F.get(starts, part) + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at")


def newest_half(records: DataFrame, order: str = "line_no") -> DataFrame:
    """Retention: drops the older ``floor(n / 2)`` records by their order."""
    ranked = numbered(records, F.desc(order))
    n = ranked.count()
    return ranked.where(F.col("rank") <= n - n // 2).drop("rank")


def expired(files: DataFrame, keep: int = 200) -> DataFrame:
    """Log files beyond the newest ``keep``."""
    newest = files.orderBy(F.desc("name")).limit(keep)
    return files.join(newest.select("name"), "name", "left_anti")


def several_remotes(records: DataFrame) -> DataFrame:
    return records.agg((F.countDistinct("remote") > 1).alias("show_remote"))


def to_report(row: DataFrame) -> DataFrame:
    """Each row as JSON."""
    return row.select(F.to_json(F.struct(*row.columns)).alias("json"))
