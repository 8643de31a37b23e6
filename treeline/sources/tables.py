"""The relations of snapshot analytics, derived from the tables of one directory.

Every function gives a DataFrame with an explicit set of columns; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions.hashing import blob_hash, sha


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_path() -> Column:
    return F.concat(F.lit("docs/"), F.col("lang"), F.lit("/"), F.col("source"), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 7, "0"), F.lit(".txt"))


def blobs(spark: SparkSession, sf_dir: str, suffix: Column | None = None) -> DataFrame:
    """``doc_id, path, text, size, mode, mtime_secs``: a file for each document (null text: empty)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    text = text if suffix is None else F.concat(text, suffix)
    mode = F.when(F.col("doc_id") % 17 == 0, "755")
    return table(spark, sf_dir, "documents").select("doc_id", doc_path().alias("path"), text.alias("text")).select("*", F.octet_length("text").cast("long").alias("size"), mode.alias("mode"), (F.lit(1700000000) + F.col("doc_id") * 60).alias("mtime_secs"))


def snapshot(spark: SparkSession, sf_dir: str, name: str = "base") -> DataFrame:
    """``path, hash, size, mode, mtime_secs`` of the base, local or remote state."""
    m = F.col("doc_id") % 40
    if name == "base":
        gone, suffix, flipped = [3, 4, 6, 8], F.lit(""), []
    elif name == "local":
        gone, flipped = [4, 5, 7, 9], [15, 16]
        suffix = F.when(m.isin(10, 11, 12, 13), " [L]").when(m == 14, " [S]").otherwise("")
    else:
        gone, flipped = [3, 5, 12, 20], []
        suffix = F.when(m.isin(8, 9, 11, 16, 18, 19), " [R]").when(m == 14, " [S]").otherwise("")
    files = blobs(spark, sf_dir, suffix).where(~m.isin(*gone))
    other = F.when(F.col("mode").isNull(), "755")
    mode = F.when(m.isin(*flipped), other).otherwise(F.col("mode")) if flipped else F.col("mode")
    return files.select("path", blob_hash(F.encode("text", "UTF-8")).alias("hash"), "size", mode.alias("mode"), "mtime_secs")


def io_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each command run; only ``purchase`` runs have ``pack_detail``."""
    k = F.get_json_object("props", "$.k").cast("long")
    detail = F.struct((F.col("event_id") % 4).alias("deltas_merged"), k.alias("packs_before"), F.greatest(k - 1, F.lit(0)).alias("packs_after"), (F.col("user_id") * 100).alias("orphaned_bytes"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("line_no"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("event_type").alias("cmd"),
        F.concat(F.lit("r"), F.col("user_id") % 3).alias("remote"),
        (F.col("event_id") % 5).alias("exists_found"),
        (F.col("event_id") % 3).alias("exists_miss"),
        k.alias("writes"),
        F.floor(F.col("value") * 1000).alias("write_bytes"),
        (F.col("user_id") % 7).alias("reads"),
        (F.col("user_id") % 7 * 512).alias("read_bytes"),
        F.when(F.col("event_type") == "purchase", detail).alias("pack_detail"),
    )


#: Layer and depth of each span label.
LABELS = {"click": ("L1", 0), "view": ("L1", 1), "purchase": ("L6", 2), "scroll": ("L7", 2), "login": ("L2", 1)}


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, line_no, label, layer, depth, kind, micros``: start and end lines of timers."""
    at = F.expr("unix_micros(cast(ts as timestamp))")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", at.alias("at"))
    first = events.groupBy("user_id").agg(F.min("at").alias("first"))
    layer, deep = F.lit("L7"), F.lit(1)
    for name, (tag, depth) in LABELS.items():
        layer, deep = F.when(F.col("event_type") == name, tag).otherwise(layer), F.when(F.col("event_type") == name, depth).otherwise(deep)
    return events.join(first, "user_id").select(
        F.col("user_id").alias("file"), F.col("event_id").alias("line_no"), F.col("event_type").alias("label"), layer.alias("layer"),
        deep.alias("depth"), F.when(F.col("event_id") % 2 == 0, "start").otherwise("end").alias("kind"), (F.col("at") - F.col("first")).alias("micros"),
    )


def index_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct ``hash`` of the index entries; equal keys meet before they become hashes, which are much longer."""
    keys = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key")).distinct()
    return keys.select(sha(F.encode("key", "UTF-8")).alias("hash"))


def index_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``hash, generation, kind, length, pack, seq``: one entry for each line item, hashes repeating across generations."""
    key = F.concat_ws("-", "l_orderkey", "l_linenumber")
    length = F.when(F.col("l_suppkey") % 10 == 0, F.floor(F.col("l_quantity"))).otherwise(F.floor(F.col("l_extendedprice") * 10)).cast("long")
    kind = F.when(F.col("length") < 256, "inline").when(F.col("length") < 1048576, "pack").otherwise("standalone")
    rows = table(spark, sf_dir, "lineitem").select(sha(F.encode(key, "UTF-8")).alias("hash"), (F.col("l_suppkey") % 4).alias("generation"), length.alias("length"), F.concat(F.lit("p"), F.col("l_partkey") % 97).alias("pack"), "l_partkey", "l_suppkey", "l_extendedprice")
    return rows.withColumn("kind", kind)


def url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, path``: the host and path of each page."""
    path = F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(path, "/+$", "").alias("path"))


def append_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, turn, n, line``: time-stamped log lines of each conversation."""
    from pyspark.sql.window import Window

    line = F.concat(F.lit(": "), F.lit(1000) + F.col("turn") * 10, F.lit(":0;"), F.translate(F.coalesce("text", F.lit("")), "\n", " "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.count("*").over(Window.partitionBy("conv_id")).alias("n"), line.alias("line"))
