"""Files as relations: working trees, object listings, JSONL records, logs and stub records."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions.hashing import blob_hash
from treeline.functions.paths import ancestors, in_scope, stub_logical

IO_SCHEMA = (
    "ts string, cmd string, remote string, exists_found bigint, exists_miss bigint, writes bigint, write_bytes bigint, reads bigint, read_bytes bigint, "
    "pack_files_written bigint, pack_sizes_bytes array<bigint>, duration_ms bigint, deltas_after bigint, pack_detail struct<deltas_merged:bigint,packs_before:bigint,"
    "packs_after:bigint,consolidated_bytes_in:bigint,consolidated_bytes_out:bigint,cold_splits:bigint,hot_index_entries:bigint,bloom_elements:bigint,orphaned_bytes:bigint,pack_sizes_after:array<bigint>>"
)
STUB_SCHEMA = "target_type string, hash string, size bigint, mtime string, mode string, blob_count bigint"
STAT_SCHEMA = "path string, mtime_secs bigint, mtime_nanos int, fs_size bigint, hash string, is_unsafe boolean"
INDEX_SCHEMA = "hash string, kind string, data binary, pack_hash string, offset bigint, length bigint, generation bigint"


def _relative(root: str):
    return F.regexp_replace(F.regexp_replace(F.col("_file"), "^[a-z]+:/*", "/"), "^" + root.rstrip("/") + "/", "")


def working_tree(spark: SparkSession, root: str, with_content: bool = False, scopes: list[str] | None = None, pattern: str | None = None) -> DataFrame:
    """``path, size, mtime_secs, mtime_nanos, hash`` (and ``content``) of all files below a folder.

    Without ``with_content`` bodies are hashed and dropped in the scan.  Spark's readers leave
    out empty files; :func:`empty_files` has those.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader if pattern is None else reader.option("pathGlobFilter", pattern)
    micros = F.expr("unix_micros(modificationTime)")
    files = reader.load(root).select(F.col("path").alias("_file"), F.col("length").alias("size"), F.floor(micros / 1000000).cast("long").alias("mtime_secs"), (F.pmod(micros, F.lit(1000000)) * 1000).cast("int").alias("mtime_nanos"), "content")
    files = files.select(_relative(root).alias("path"), "size", "mtime_secs", "mtime_nanos", blob_hash(F.col("content")).alias("hash"), *(["content"] if with_content else []))
    return files if not scopes else files.where(in_scope(F.col("path"), scopes))


def _walk(spark: SparkSession, root: str, wanted) -> list:
    """File statuses below a folder that ``wanted`` takes; walked on the driver, as Spark's own listing is."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    found, walk = [], top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(top, True)
    while walk.hasNext():
        status = walk.next()
        if wanted(status):
            found.append(status)
    return found


def empty_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, size, mtime_secs, mtime_nanos, hash`` of files without content, which Spark's readers leave out."""
    found = []
    for status in _walk(spark, root, lambda s: s.getLen() == 0):
        secs, millis = divmod(status.getModificationTime(), 1000)
        found.append((status.getPath().toString(), 0, secs, millis * 1_000_000))
    rows = spark.createDataFrame(found, "_file string, size long, mtime_secs long, mtime_nanos int")
    return rows.select(_relative(root).alias("path"), "size", "mtime_secs", "mtime_nanos", blob_hash(F.lit(b"")).alias("hash"))


def _hidden_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``_file, content`` of files of this (dotted) name, which Spark's readers leave out; read on the executors."""

    def run(batches):
        from pyarrow import fs

        for rows in batches:
            bodies = []
            for uri in rows["_file"]:
                store, path = fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
                with store.open_input_stream(path) as stream:
                    bodies.append(stream.read())
            yield rows.assign(content=bodies)

    found = [(s.getPath().toString(),) for s in _walk(spark, root, lambda s: s.getPath().getName() == name)]
    return spark.createDataFrame(found, "_file string").mapInPandas(run, "_file string, content binary")


def object_listing(spark: SparkSession, root: str) -> DataFrame:
    """``path, size``: metadata only; bodies are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.col("path").alias("_file"), F.col("length").alias("size")).select(_relative(root).alias("path"), "size")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, line``: text lines with their number in the file.

    A file is read whole by one task, for its lines have no number of their own.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("text"))
    lines = files.select("file", F.posexplode(F.split(F.regexp_replace("text", "\n$", ""), "\n")).alias("line_no", "line"), F.col("text").alias("_all"))
    return lines.where("_all <> ''").select("file", (F.col("line_no") + 1).cast("long").alias("line_no"), "line")


def io_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of JSONL files; blank and unparsable lines are left out."""
    return spark.read.schema(IO_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def recent_io_records(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The last ``n`` lines of a JSONL file, of which unparsable ones are then dropped."""
    lines = numbered_lines(spark, path).orderBy(F.desc("line_no")).limit(n)
    parsed = lines.select("line_no", F.from_json("line", IO_SCHEMA, {"mode": "PERMISSIVE"}).alias("r"))
    return parsed.where("r.cmd is not null").select("line_no", "r.*").orderBy("line_no")


def log_files(spark: SparkSession, root: str) -> DataFrame:
    """``name, size, is_latest``: log files, newest first."""
    from pyspark.sql.window import Window

    files = object_listing(spark, root).where(F.col("path").endswith(".log"))
    named = files.select(F.regexp_replace("path", r"\.log$", "").alias("name"), "size")
    newest = Window.orderBy(F.desc("name"))  # one row for each log file
    return named.select("name", "size", (F.row_number().over(newest) == 1).alias("is_latest")).orderBy(F.desc("name"))


def stubs(spark: SparkSession, root: str, app: str = "snap") -> DataFrame:
    """Stub records below a folder by the path they stand for; none below a directory stub."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{app}-stub").load(root)
    files = files.select(F.col("path").alias("_file"), "content").unionByName(_hidden_files(spark, root, f".{app}-stub"))
    read = files.select("_file", F.from_json(F.decode("content", "UTF-8"), STUB_SCHEMA).alias("s"))
    named = read.select(_relative(root).alias("file"), "s.*").withColumn("path", stub_logical(F.col("file"), app))
    named = named.withColumn("target_type", F.coalesce("target_type", F.lit("blob"))).withColumn("blob_count", F.coalesce("blob_count", F.lit(0)))
    folders = named.where(F.col("file").endswith(f"/.{app}-stub")).select(F.col("path").alias("above")).distinct()
    inside = named.select("path", F.explode(ancestors(F.col("path"))).alias("above")).join(folders, "above", "left_semi").select("path").distinct()
    return named.join(inside, "path", "left_anti").drop("file")


def stat_cache(spark: SparkSession, path: str, scope: str | None = None) -> DataFrame:
    """The cache (sorted by path); a missing folder is an empty cache; ``scope`` prunes by a range of paths."""
    try:
        cache = spark.read.schema(STAT_SCHEMA).parquet(path)
    except AnalysisException:
        cache = spark.createDataFrame([], STAT_SCHEMA)
    return cache if not scope else cache.where((F.col("path") >= scope) & (F.col("path") < scope + "0") & in_scope(F.col("path"), [scope]))


def index_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX_SCHEMA).parquet(path)
