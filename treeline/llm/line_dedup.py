"""Corpus-wide line dedup with levelled sorted runs of line hashes.

Documents arrive in batches of descending id.  A batch's line hashes are
merge-anti-joined with the sorted runs: a hash that no run holds is new, and the batch's
largest document holding it keeps the line; every other (document, hash)
pair becomes a candidate.  The batch then adds its own run (hash, documents, keeper).
``FANOUT`` runs of a level are compacted into one of the next.  When all batches are in,
candidates whose hash was found in enough documents lose their lines.

A line's key is the line stripped of ASCII white space with A-Z lower-cased; keys under
``min_chars`` code points are never dropped.  Null or empty text is one empty line.
Rows that repeat a document id count as one document; a null id counts as the smallest.
Hashes have 128 bits.  A hot line's pairs are counted by task
first and joined in ``SALTS`` parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.shared import discard, filled, shared_dir, slices

FANOUT = 2
#: Salt values over which the pairs of one line are spread.
SALTS = 16
BATCHES = 4
NO_ID = -(1 << 63)
STRIPPED = b" \t\n\x0b\x0c\r"
#: A-Z to a-z over bytes; UTF-8 bytes of other characters stay.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of a line's key, None if the key is too short."""
    key = line.strip(STRIPPED)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key.translate(LOWER))


class LineRuns:
    """Sorted runs ``(h, n_docs, keeper)`` in the shared folder, by level."""

    def __init__(self, spark: SparkSession):
        self.spark, self.levels = spark, [[]]

    def _write(self, run: DataFrame) -> str:
        path = shared_dir(self.spark, "line-run")
        run.sortWithinPartitions("h").write.parquet(path)
        return path

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("h binary, n_docs long, keeper long").parquet(*paths)

    def merged(self) -> DataFrame | None:
        """One row for each hash of all runs."""
        paths = [p for level in self.levels for p in level]
        return _compact(self._read(paths)) if paths else None

    def add(self, run: DataFrame) -> None:
        path, level = self._write(run), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(path)
            if len(self.levels[level]) < FANOUT:
                return
            old, self.levels[level] = self.levels[level], []
            path = self._write(_compact(self._read(old)))
            for p in old:
                discard(self.spark, p)
            level += 1


def _compact(runs: DataFrame) -> DataFrame:
    return runs.groupBy("h").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))


def _line_hashes(docs: DataFrame, bounds: list[int], min_chars: int) -> DataFrame:
    """``(batch, h, doc)`` for each distinct key of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in slices(batch, "text"):
                doc, keys = [], []
                for i, t in zip(part.column("doc").to_pylist(), text.to_pylist(), strict=True):
                    own = {line_key(line, min_chars) for line in t.split(b"\n")} - {None}
                    doc += [i] * len(own)
                    keys += own
                at = [sum(i >= b for b in bounds) for i in doc]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(keys, pa.binary()), pa.array(doc, pa.int64())], names=["batch", "h", "doc"])

    return docs.mapInArrow(run, "batch int, h binary, doc long")


def _salted(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int"))


def _for_each_salt(keys: DataFrame) -> DataFrame:
    return keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def dropped_keys(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, batches: int = BATCHES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc, drop array<binary>)``: the line keys that each document loses."""
    spark = docs.sparkSession
    plain = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text_column).alias("text"))
    cuts = plain.agg(F.percentile_approx("doc", [k / batches for k in range(1, batches)], 1000).alias("q")).first().q
    staged = shared_dir(spark, "lines")
    _line_hashes(plain, sorted(set(cuts or [])), min_chars).write.partitionBy("batch").parquet(staged)
    lines = spark.read.schema("h binary, doc long, batch int").parquet(staged)
    runs, candidates = LineRuns(spark), []
    for batch in range(len(set(cuts or [])), -1, -1):
        own = lines.where(F.col("batch") == batch).select("h", "doc").distinct()
        keys = own.groupBy("h").agg(F.count("*").alias("n_docs"), F.max("doc").alias("keeper"))
        seen = runs.merged()
        if seen is None:
            keys = keys.withColumn("new", F.lit(True))
        else:
            fresh = seen.select("h", F.lit(False).alias("old"))
            keys = keys.join(fresh, "h", "left").withColumn("new", F.coalesce("old", F.lit(True))).drop("old")
        path = shared_dir(spark, "batch-keys")
        keys.write.parquet(path)
        keys = spark.read.schema(keys.schema).parquet(path)
        repeated = _for_each_salt(keys.where(~F.col("new") | (F.col("n_docs") > 1)))
        lost = _salted(own).join(repeated, ["h", "salt"]).where(~F.col("new") | (F.col("doc") != F.col("keeper")))
        out = shared_dir(spark, "line-candidates")
        lost.select("h", "doc").write.parquet(out)
        candidates.append(out)
        runs.add(keys.select("h", "n_docs", F.when(F.col("new"), F.col("keeper")).alias("keeper")))
        discard(spark, path)
    discard(spark, staged)
    frequent = _for_each_salt(runs.merged().where(F.col("n_docs") >= min_docs).select("h"))
    lost = _salted(spark.read.schema("h binary, doc long").parquet(*candidates)).join(frequent, ["h", "salt"], "left_semi")
    return lost.groupBy("doc").agg(F.collect_set("h").alias("drop"))


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, batches: int = BATCHES, id_column: str = "doc_id", text_column: str = "text", digests_only: bool = False) -> DataFrame:
    """Drop repeated lines from every document except the largest id that holds them.

    Returns all columns of ``docs`` with the text replaced (null stays null
    unless it had no line to lose), or with ``digests_only`` the columns
    ``id_column, n_lines, n_dropped, kept_sha256``.
    """
    drops = dropped_keys(docs, min_docs, min_chars, batches, id_column, text_column)
    names = docs.columns
    wanted = [id_column, text_column] if digests_only else names
    plain = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(wanted)])
    id_at, text_at = wanted.index(id_column), wanted.index(text_column)
    joined = plain.join(drops, F.coalesce(F.col(f"c{id_at}").cast("long"), F.lit(NO_ID)) == F.col("doc"), "left").drop("doc")
    kinds = [f.dataType.simpleString() for f in plain.schema.fields]
    schema = f"c{id_at} {kinds[id_at]}, n_lines long, n_dropped long, kept_sha256 string" if digests_only else ", ".join(f"c{i} {k}" for i, k in enumerate(kinds))
    out_names = [c.split()[0] for c in schema.split(", c")] if not digests_only else [f"c{id_at}", "n_lines", "n_dropped", "kept_sha256"]

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_in:
            for part, text in slices(batch, f"c{text_at}"):
                kept, n_lines, n_dropped = [], [], []
                for t, drop in zip(text.to_pylist(), part.column("drop").to_pylist(), strict=True):
                    rows = t.split(b"\n")
                    n_lines.append(len(rows))
                    if drop:
                        gone = set(drop)
                        rows = [r for r in rows if line_key(r, min_chars) not in gone]
                        t = b"\n".join(rows)
                    n_dropped.append(n_lines[-1] - len(rows))
                    kept.append(t)
                if digests_only:
                    cols = [part.column(id_at), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, names=out_names)
                else:
                    null = part.column(text_at).is_null().to_numpy(zero_copy_only=False)
                    cols = list(part.columns[: len(names)])
                    cols[text_at] = pa.array(kept, pa.binary(), mask=null).cast(pa.string())
                    yield pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(len(names))])

    out = joined.mapInArrow(run, schema)
    return out.withColumnRenamed(f"c{id_at}", id_column) if digests_only else out.toDF(*names)
