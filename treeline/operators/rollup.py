"""Directory roll-ups: sizes, counts, times and Merkle hashes over path prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.functions.hashing import TAG_TREE, tag
from treeline.functions.paths import ancestors, base_name, depth, parent
from treeline.sources.staging import cut


def directory_totals(leaves: DataFrame) -> DataFrame:
    """``path, size, blob_count, mtime_secs`` of every directory (root: empty path); a null time is ignored.

    Leaves are first summed by their own directory, so that deep trees repeat
    directories and not files for each ancestor.
    """
    own = leaves.groupBy(parent(F.col("path")).alias("path")).agg(F.sum("size").alias("size"), F.count("*").alias("blob_count"), F.max("mtime_secs").alias("mtime_secs"))
    chain = own.select(F.explode(F.when(F.col("path") == "", F.array(F.lit(""))).otherwise(F.concat(ancestors(F.col("path")), F.array("path")))).alias("dir"), "size", "blob_count", "mtime_secs")
    return chain.groupBy(F.col("dir").alias("path")).agg(F.sum("size").alias("size"), F.sum("blob_count").alias("blob_count"), F.max("mtime_secs").alias("mtime_secs"))


def quoted(text: F.Column) -> F.Column:
    """A JSON string: quotes, backslashes and control characters are escaped."""
    plain = F.concat(F.lit('"'), text, F.lit('"'))
    return F.when(text.rlike(r'["\\\x00-\x1F]'), F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)).otherwise(plain)


def entry_json(kind: str) -> F.Column:
    """One entry in canonical form: kind, name, hash, size and, if set, mode."""
    fixed = [F.lit('{"kind":"' + kind + '","name":'), quoted(F.col("name")), F.lit(',"hash":"'), F.col("hash"), F.lit('","size":'), F.col("size").cast("string")]
    mode = F.when(F.col("mode").isNotNull(), F.concat(F.lit(',"mode":"'), F.col("mode"), F.lit('"'))).otherwise("")
    return F.concat(*fixed, mode, F.lit("}"))


def merkle(leaves: DataFrame) -> DataFrame:
    """``path, hash, size`` of every directory: SHA-256 over its entries in byte order of their names.

    Works upwards by level; a level is one aggregation by directory.  The number of levels is
    that of the deepest path.  A directory's entries meet in one task, as they do in its hash.
    """
    entries = leaves.select(parent(F.col("path")).alias("dir"), base_name(F.col("path")).alias("name"), "hash", "size", "mode", depth(F.col("path")).alias("depth"))
    entries = entries.select("dir", "depth", "size", F.struct("name", entry_json("blob").alias("json")).alias("entry"))
    deepest = entries.agg(F.max("depth")).first()[0] or 1
    level, found = entries.where(F.col("depth") == deepest), None
    for d in range(deepest, 0, -1):
        body = F.concat(tag(TAG_TREE), F.encode(F.concat(F.lit('{"kind":"normal","entries":['), F.array_join(F.transform(F.array_sort(F.collect_list("entry")), lambda e: e["json"]), ","), F.lit("]}")), "UTF-8"))
        dirs = cut(level.groupBy("dir").agg(F.sha2(body, 256).alias("hash"), F.sum("size").alias("size")))  # else each level would redo all below it
        found = dirs if found is None else found.unionByName(dirs)
        if d > 1:
            above = dirs.select(parent(F.col("dir")).alias("_up"), base_name(F.col("dir")).alias("name"), "hash", "size", F.lit(None).cast("string").alias("mode"))
            above = above.select(F.col("_up").alias("dir"), F.lit(d - 1).alias("depth"), "size", F.struct("name", entry_json("tree").alias("json")).alias("entry"))
            level = above.unionByName(entries.where(F.col("depth") == d - 1))
    return found.withColumnRenamed("dir", "path")
