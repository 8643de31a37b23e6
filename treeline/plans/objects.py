"""Plans over logs, the object index, graphs, chunks and line merges."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeline.functions.content import route
from treeline.functions.hashing import hash_prefix, manifest_bytes, manifest_chunks, optimal_bits, sha
from treeline.operators import chunks, graph, index, logs, merge3
from treeline.plans import sql as S
from treeline.plans.registry import query
from treeline.plans.storage import _BLOOM, _latest
from treeline.sources import tables as T

_SHARD = "CAST('0x' || substr(hash, 1, 2) AS BIGINT)"


@query("wn03_spans", f"WITH {S.SPANS} SELECT * FROM spans")
def spans(spark, sf):
    return logs.spans(T.log_lines(spark, sf))


@query("ag18_label_stats", f"WITH {S.SPANS} SELECT label, layer, count(*) AS count, CAST(sum(end_micros - start_micros) AS BIGINT) AS total_micros, round(avg(end_micros - start_micros), 3) AS avg_micros, max(end_micros - start_micros) AS max_micros FROM spans GROUP BY label, layer")
def label_stats(spark, sf):
    return logs.label_stats(logs.spans(T.log_lines(spark, sf)), "max").withColumn("avg_micros", F.round("avg_micros", 3))


@query(
    "ag19_layer_totals",
    f"""WITH {S.SPANS}, t AS (SELECT layer, CAST(sum(CASE WHEN layer <> 'L1' OR depth = 0 THEN end_micros - start_micros ELSE 0 END) AS BIGINT) AS total_micros FROM spans GROUP BY layer)
    SELECT layer, total_micros, round(total_micros * 100.0 / coalesce((SELECT nullif(max(total_micros), 0) FROM t WHERE layer = 'L1'), (SELECT max(total_micros) FROM t)), 6) AS share_pct FROM t WHERE total_micros > 0""",
)
def layer_totals(spark, sf):
    return logs.layer_totals(logs.spans(T.log_lines(spark, sf))).withColumn("share_pct", F.round("share_pct", 6))


@query("prd23_filtered_spans", f"WITH {S.SPANS} SELECT * FROM spans WHERE layer IN ('L1', 'L7')")
def filtered_spans(spark, sf):
    return logs.spans(T.log_lines(spark, sf)).where(logs.layer_filter([" l1", "L7"]))


_TAG = "CASE layer WHEN 'L1' THEN 'L1 cmd' WHEN 'L2' THEN 'L2 ser' WHEN 'L6' THEN 'L6 pak' ELSE 'L7 sto' END"


@query("sc25_parse_lines", f"WITH {S.LINES} SELECT file, line_no, layer, round(floor(micros / 1000000.0), 3) AS elapsed_secs, depth, label || ': ' || kind AS text FROM lines WHERE line_no % 7 <> 0")
def parse_lines(spark, sf):
    rows = T.log_lines(spark, sf)
    tag = F.when(F.col("layer") == "L1", "L1 cmd").when(F.col("layer") == "L2", "L2 ser").when(F.col("layer") == "L6", "L6 pak").otherwise("L7 sto")
    tag = F.when(F.col("line_no") % 7 == 0, "L9 xxx").otherwise(tag)
    text = F.concat_ws(": ", "label", "kind")
    lines = rows.select("file", "line_no", logs.format_line("app", tag, F.floor(F.col("micros") / 1000000).cast("double"), F.col("depth"), text).alias("line"))
    return logs.parse_lines(lines).select("file", "line_no", "layer", "elapsed_secs", "depth", "text")


@query("prd24_grep", f"WITH {S.LINES} SELECT file, line_no FROM lines WHERE contains(label || ': ' || kind, 'w: st')")
def grep(spark, sf):
    return T.log_lines(spark, sf).where(F.concat_ws(": ", "label", "kind").contains("w: st")).select("file", "line_no")


@query("wn04_latest_entries", f"WITH {S.LATEST} SELECT hash, kind, length, pack, generation FROM latest")
def latest_entries(spark, sf):
    return _latest(spark, sf).select("hash", "kind", "length", "pack", "generation")


@query("jn13_locate", f"WITH {S.INDEX}, w AS (SELECT DISTINCT sha256(CAST(o_orderkey AS VARCHAR) || '-1') AS hash FROM orders), f AS (SELECT hash, min(3 - generation) AS tier FROM idx GROUP BY hash) SELECT w.hash, f.tier FROM w LEFT JOIN f USING (hash)")
def locate(spark, sf):
    tiers = T.index_entries(spark, sf).withColumn("tier", 3 - F.col("generation")).select("hash", "tier", "kind", "length")
    wanted = T.table(spark, sf, "orders").select(sha(F.encode(F.concat(F.col("o_orderkey").cast("string"), F.lit("-1")), "UTF-8")).alias("hash"))
    return index.locate(wanted, tiers).select("hash", "tier")


_REACH = "r AS (SELECT DISTINCT sha256(CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)) AS hash FROM lineitem WHERE l_orderkey % 3 = 0)"


def _reachable(spark, sf):
    return T.table(spark, sf, "lineitem").where("l_orderkey % 3 = 0").select(sha(F.encode(F.concat_ws("-", "l_orderkey", "l_linenumber"), "UTF-8")).alias("hash"))


@query("jn17_hot_and_cold", f"WITH {S.LATEST}, {_REACH} SELECT hash, CASE WHEN kind = 'standalone' OR hash IN (SELECT hash FROM r) THEN 'hot' ELSE 'cold' END AS tier FROM latest")
def hot_and_cold(spark, sf):
    hot, cold = index.hot_and_cold(_latest(spark, sf), _reachable(spark, sf))
    return hot.select("hash", F.lit("hot").alias("tier")).unionByName(cold.select("hash", F.lit("cold").alias("tier")))


@query("pk15_compaction_metrics", f"WITH {S.LATEST}, {_REACH}, t AS (SELECT kind = 'standalone' OR hash IN (SELECT hash FROM r) AS hot FROM latest) SELECT count(*) AS merged_entries, count(*) FILTER (WHERE hot) AS hot_index_entries, count(*) FILTER (WHERE NOT hot) AS cold_entries FROM t")
def compaction_metrics(spark, sf):
    return index.compact(T.index_entries(spark, sf), _reachable(spark, sf), ["l_partkey", "l_suppkey", "l_extendedprice", "length"])["metrics"]


@query("pk06_small_packs", f"WITH {S.LATEST} SELECT pack, CAST(sum(length) AS BIGINT) AS bytes, count(*) AS entries FROM latest WHERE kind = 'pack' AND l_pack_small IS NULL GROUP BY pack HAVING sum(length) < 30000000".replace(" AND l_pack_small IS NULL", ""))
def small_packs(spark, sf):
    return index.small_packs(_latest(spark, sf), 30_000_000)


@query("pk01_routes", f"WITH {S.LATEST} SELECT kind, count(*) AS n, CAST(sum(length) AS BIGINT) AS bytes FROM latest GROUP BY kind")
def routes(spark, sf):
    return _latest(spark, sf).groupBy(route(F.col("length")).alias("kind")).agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


@query("pk09_cold_shards", f"WITH {S.LATEST} SELECT {_SHARD} // 16 AS shard, count(*) AS entries FROM latest GROUP BY 1")
def cold_shards(spark, sf):
    return _latest(spark, sf).groupBy(index.shard_of(F.col("hash"), 4).alias("shard")).agg(F.count("*").alias("entries"))


@query("pk07_append_cold", f"WITH {S.LATEST} SELECT hash, {_SHARD} // 64 AS shard FROM latest")
def append_cold(spark, sf):
    entries = T.index_entries(spark, sf).select("hash", "generation", "kind", "length")
    return index.add_to_shards(entries.where("generation < 2"), entries.where("generation >= 2"), 2).select("hash", "shard")


@query("ag22_crowded_byte", f"WITH {S.LATEST} SELECT substr(hash, 1, 2) AS byte, count(*) AS count FROM latest GROUP BY 1 ORDER BY count DESC, byte LIMIT 1")
def crowded_byte(spark, sf):
    return index.crowded_byte(_latest(spark, sf))


@query(
    "pk08_split_shard",
    f"""WITH {S.LATEST}, s AS (SELECT hash, {_SHARD} // 64 AS shard FROM latest), big AS (SELECT shard FROM s GROUP BY shard HAVING count(*) * 64 > 65536 ORDER BY count(*) DESC, shard LIMIT 1),
    b AS (SELECT substr(hash, 1, 2) AS byte FROM s WHERE shard = (SELECT shard FROM big) GROUP BY 1 ORDER BY count(*) DESC, byte LIMIT 1)
    SELECT hash, shard, byte FROM s, b WHERE shard = (SELECT shard FROM big) AND substr(hash, 1, 2) = byte""",
)
def split_shard(spark, sf):
    shards = _latest(spark, sf).select("hash", index.shard_of(F.col("hash"), 2).alias("shard"))
    return index.split_shard(shards, 64, 65536).select("hash", "shard", "byte")


@query("ag25_bloom_table", f"WITH {_BLOOM} SELECT DISTINCT bit FROM bits")
def bloom_table(spark, sf):
    return index.bloom_table(T.index_entries(spark, sf).select("hash").distinct())


@query("ag26_bloom_fill", f"WITH {_BLOOM} SELECT count(DISTINCT bit) AS set_bits, round(count(DISTINCT bit) / 958506, 6) AS fill FROM bits")
def bloom_fill(spark, sf):
    return index.bloom_fill(index.bloom_table(T.index_entries(spark, sf).select("hash").distinct()), optimal_bits(100_000, 0.01))


@query(
    "pk10_may_contain",
    f"WITH {_BLOOM}, inserted AS (SELECT DISTINCT bit FROM bits WHERE substr(hash, 1, 1) < '8') SELECT hash FROM bits LEFT JOIN inserted i ON bits.bit = i.bit GROUP BY hash HAVING count(*) = count(i.bit)",
)
def may_contain(spark, sf):
    inserted = T.index_entries(spark, sf).select("hash").where("substring(hash, 1, 1) < '8'")
    return index.may_contain(T.index_hashes(spark, sf), index.bloom_table(inserted))


@query("wn07_running_offsets", f"WITH {S.LATEST} SELECT hash, pack, CAST(coalesce(sum(length) OVER (PARTITION BY pack ORDER BY hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset FROM latest")
def running_offsets(spark, sf):
    return index.running_offsets(_latest(spark, sf), "pack", "hash").select("hash", "pack", "offset")


@query("pk02_packed")
def packed(spark, sf):
    """A fold with resets: held against a Python fold in the tests."""
    rows = _latest(spark, sf).select("hash", "pack", "length")
    return index.packed(rows, "pack", "hash")


@query("gr01_reachable", "WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS parent, l_partkey // 2 AS child FROM lineitem), w(hash) AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey % 101 = 7 UNION SELECT child FROM w JOIN e ON parent = hash) SELECT CAST(hash AS VARCHAR) AS hash FROM w")
def reachable(spark, sf):
    parts = T.table(spark, sf, "lineitem").select("l_partkey").distinct()
    edges = parts.select(F.col("l_partkey").cast("string").alias("parent"), F.expr("cast(l_partkey div 2 as string)").alias("child"))
    return graph.reachable(parts.where("l_partkey % 101 = 7").select(F.col("l_partkey").cast("string").alias("hash")), edges)


@query("jn11_upload_plan", "WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS parent, l_partkey // 2 AS child FROM lineitem), w(hash) AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey % 101 = 7 AND l_partkey % 5 <> 3 UNION SELECT child FROM w JOIN e ON parent = hash WHERE child % 5 <> 3) SELECT CAST(hash AS VARCHAR) AS hash FROM w")
def upload_plan(spark, sf):
    parts = T.table(spark, sf, "lineitem").select("l_partkey").distinct()
    edges = parts.select(F.col("l_partkey").cast("string").alias("parent"), F.expr("cast(l_partkey div 2 as string)").alias("child"))
    remote = edges.select(F.col("child").alias("hash")).unionByName(edges.select(F.col("parent").alias("hash"))).where("cast(hash as bigint) % 5 = 3")
    return graph.upload_plan(parts.where("l_partkey % 101 = 7").select(F.col("l_partkey").cast("string").alias("hash")), edges, remote)


@query("gr04_flatten", f"WITH {S.SNAPSHOTS} SELECT path, hash, size FROM base")
def flatten(spark, sf):
    from treeline.functions.paths import base_name, parent
    from treeline.operators.rollup import merkle

    base = T.snapshot(spark, sf)
    dirs = merkle(base).select(F.col("path").alias("dir"), F.col("hash").alias("tree_hash"), "size")
    blobs = base.select(parent(F.col("path")).alias("dir"), base_name(F.col("path")).alias("name"), F.lit("blob").alias("kind"), "hash", "size")
    trees = dirs.where("dir <> ''").select(parent(F.col("dir")).alias("dir"), base_name(F.col("dir")).alias("name"), F.lit("tree").alias("kind"), F.col("tree_hash").alias("hash"), "size")
    entries = blobs.unionByName(trees).join(dirs.select("dir", "tree_hash"), "dir").select("tree_hash", "name", "kind", "hash", "size")
    root = dirs.where("dir = ''").first()["tree_hash"]
    return graph.flatten(root, entries).select("path", "hash", "size")


_CHUNKS = f"""{S.FILES}, c AS (SELECT path, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS idx FROM files),
  hc AS (SELECT path, idx, line, sha256('\\xED\\xF3'::BLOB || encode(line)) AS hash FROM c)"""


@query("ch07_line_chunks", f"WITH {_CHUNKS} SELECT hash, min(line) AS line, count(*) AS uses FROM hc GROUP BY hash")
def line_chunks(spark, sf):
    return chunks.line_chunks(T.blobs(spark, sf)).groupBy("hash").agg(F.min("line").alias("line"), F.count("*").alias("uses"))


@query("ch03_manifests", f"WITH {_CHUNKS} SELECT path, count(*) AS n_chunks, count(*) > 1 AS is_chunked, sha256(string_agg(hash, '' ORDER BY idx)) AS manifest FROM hc GROUP BY path")
def manifests(spark, sf):
    found = chunks.manifests(chunks.line_chunks(T.blobs(spark, sf)))
    back = manifest_chunks(manifest_bytes(F.col("chunk_hashes")))
    return found.select("path", "n_chunks", "is_chunked", sha(F.encode(F.array_join(back, ""), "UTF-8")).alias("manifest"))


@query("ch05_reassembled", f"WITH {S.FILES} SELECT path, sha256(text) AS content_hash FROM files WHERE text <> ''")
def reassembled(spark, sf):
    files = T.blobs(spark, sf).select("path", F.encode("text", "UTF-8").alias("content"))
    parts = chunks.chunked(files, 256, 1024, 4096)
    return chunks.reassembled(chunks.manifests(parts), parts).select("path", sha(F.col("content")).alias("content_hash"))


@query("ch01_chunk_sizes")
def chunk_sizes(spark, sf):
    """Content-defined chunks; their bounds and reassembly are held in the tests."""
    files = T.blobs(spark, sf).select("path", F.encode("text", "UTF-8").alias("content"))
    return chunks.chunked(files, 256, 1024, 4096, with_bytes=False)


@query("lm06_merged_appends", f"WITH {S.LOGS} SELECT CAST(conv_id AS VARCHAR) AS path, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq, line FROM logs")
def merged_appends(spark, sf):
    rows = T.append_logs(spark, sf)
    side = F.when(F.col("turn") <= F.col("n") - 3, 0).when(F.col("turn") == F.col("n") - 2, 1).otherwise(2)
    return merge3.merged_appends(rows.select(F.col("conv_id").cast("string").alias("path"), side.alias("side"), F.col("turn").alias("no"), "line"))


def _three_files(spark, sf, rewrite: bool = False):
    rows = T.append_logs(spark, sf)
    text = lambda which, line="line": F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("turn", F.concat(F.col(line), F.lit("\n")).alias("t"))))), lambda x: x["t"]))
    t, n = F.col("turn"), F.col("n")
    if rewrite:
        rows = rows.withColumn("mine", F.when(t == 0, F.concat(F.col("line"), F.lit(" L"))).otherwise(F.col("line"))).withColumn("yours", F.when(t == 0, F.concat(F.col("line"), F.lit(" R"))).otherwise(F.col("line")))
    else:
        rows = rows.withColumn("mine", F.col("line")).withColumn("yours", F.col("line"))
    files = rows.groupBy(F.col("conv_id").cast("string").alias("path")).agg(text(t <= n - 3).alias("base"), text((t <= n - 3) | (t == n - 2), "mine").alias("local"), text((t <= n - 3) | (t == n - 1), "yours").alias("remote"))
    return files.select("path", *[F.encode(c, "UTF-8").alias(c) for c in ("base", "local", "remote")])


@query("lm01_merge", f"WITH {S.LOGS} SELECT CAST(conv_id AS VARCHAR) AS path, 'clean' AS outcome, sha256(string_agg(line || chr(10), '' ORDER BY turn)) AS content_hash FROM logs GROUP BY conv_id")
def merge(spark, sf):
    return merge3.merged_files(_three_files(spark, sf)).select("path", "outcome", sha(F.col("content")).alias("content_hash"))


@query("lm03_conflicts", f"WITH {S.LOGS} SELECT CAST(conv_id AS VARCHAR) AS path, CASE WHEN max(n) >= 3 THEN 'conflict' ELSE 'clean' END AS outcome FROM logs GROUP BY conv_id")
def conflicts(spark, sf):
    return merge3.merged_files(_three_files(spark, sf, rewrite=True)).select("path", "outcome")


@query("wn08_first_tier", f"WITH {S.INDEX} SELECT hash, min(generation) AS tier FROM idx GROUP BY hash")
def first_tier(spark, sf):
    return T.index_entries(spark, sf).groupBy("hash").agg(F.min("generation").alias("tier"))


@query("so09_sorted_entries", f"WITH {S.LATEST} SELECT hash, row_number() OVER (PARTITION BY {_SHARD} ORDER BY hash) AS place FROM latest")
def sorted_entries(spark, sf):
    place = Window.partitionBy(hash_prefix(F.col("hash"), 8)).orderBy("hash")
    return _latest(spark, sf).select("hash", F.row_number().over(place).cast("long").alias("place"))
