"""Plans over the smaller operators of listings, logs, packs and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from treeline.functions.formats import abbreviate, truncate
from treeline.functions.globs import is_pruned
from treeline.functions.hashing import sha
from treeline.functions.paths import ancestors, stub_logical
from treeline.operators import chunks, diff, graph, index, logs, merge3, rollup, stats
from treeline.plans import sql as S
from treeline.plans.objects import _three_files
from treeline.plans.registry import query
from treeline.plans.snapshots import _IGNORED, RULES, sides
from treeline.plans.storage import _latest
from treeline.sources import tables as T


@query(
    "prd21_git_context",
    f"WITH {S.FILES}, p AS (SELECT CASE WHEN doc_id % 97 = 0 THEN 'docs/' || lang || '/' || source || '/.git/config' ELSE path END AS path FROM files), h AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[.]git/', 1) AS home FROM p WHERE contains(path, '/.git/')) SELECT DISTINCT path FROM p WHERE EXISTS (SELECT 1 FROM h WHERE starts_with(path, home || '/'))",
)
def git_context(spark, sf):
    given = F.when(F.col("doc_id") % 97 == 0, F.concat(F.regexp_extract("path", "^(.*)/", 1), F.lit("/.git/config"))).otherwise(F.col("path"))
    return diff.git_context(T.blobs(spark, sf).select(given.alias("path")))


@query("prd25_command_filter", f"WITH {S.IO} SELECT line_no, cmd FROM io WHERE contains(cmd, 'o')")
def command_filter(spark, sf):
    return T.io_records(spark, sf).where(F.col("cmd").contains("o")).select("line_no", "cmd")


@query(
    "jn16_around_conflicts",
    f"""WITH {S.THREE_WAY}, c AS (SELECT path AS hit FROM outcomes WHERE outcome = 'conflict'), d AS (SELECT DISTINCT unnest({S.ANCESTORS}) AS path FROM base), up AS (SELECT DISTINCT unnest({S.ANCESTORS.replace('path', 'hit')}) AS path FROM c)
    SELECT path, false AS at_or_under, path IN (SELECT path FROM up) AS above FROM d""",
)
def around_conflicts(spark, sf):
    base, local, remote = sides(spark, sf)
    dirs = base.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    return diff.marked_around(dirs, diff.three_way(base, local, remote).where("outcome = 'conflict'"))


@query("jn18_navigate", f"WITH {S.SNAPSHOTS} SELECT 'docs/en' AS path, CAST(sum(size) AS BIGINT) AS size FROM base WHERE starts_with(path, 'docs/en/')")
def navigate(spark, sf):
    return graph.navigate(rollup.directory_totals(T.snapshot(spark, sf)), "docs/en").select("path", "size")


@query("gr06_listing", f"WITH {S.CHANGES} SELECT coalesce(o.change, ' ') AS status, substr(l.hash, 1, 8) AS hash, l.size, l.path FROM local l LEFT JOIN ours o USING (path) WHERE NOT {_IGNORED.replace('path', 'l.path')}")
def listing(spark, sf):
    base, local, _ = sides(spark, sf)
    return diff.listing(local, diff.diff(base, local), is_pruned(F.col("path"), RULES))


@query(
    "so11_emptied_directories",
    f"WITH {S.SNAPSHOTS}, gone AS (SELECT path FROM base WHERE starts_with(path, 'docs/fr/') OR starts_with(path, 'docs/en/src1/')), kept AS (SELECT path FROM base WHERE path NOT IN (SELECT path FROM gone)), a AS (SELECT DISTINCT unnest({S.ANCESTORS}) AS path FROM gone), b AS (SELECT DISTINCT unnest({S.ANCESTORS}) AS path FROM kept) SELECT path FROM a WHERE path <> '' AND path NOT IN (SELECT path FROM b)",
)
def emptied_directories(spark, sf):
    base = T.snapshot(spark, sf)
    gone = F.col("path").startswith("docs/fr/") | F.col("path").startswith("docs/en/src1/")
    return diff.emptied_directories(base.where(gone), base.where(~gone))


@query("so04_newest_logs", "SELECT strftime(ts, '%Y%m%d-%H%M%S') || '-' || event_type || '-' || CAST(event_id AS VARCHAR) AS name FROM events ORDER BY name DESC LIMIT 10")
def newest_logs(spark, sf):
    name = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd-HHmmss"), F.lit("-"), F.col("event_type"), F.lit("-"), F.col("event_id").cast("string"))
    return T.table(spark, sf, "events").select(name.alias("name")).orderBy(F.desc("name")).limit(10)


@query("so05_slowest_labels", f"WITH {S.SPANS} SELECT label, layer, max(end_micros - start_micros) AS max_micros FROM spans GROUP BY label, layer ORDER BY max_micros DESC, label, layer LIMIT 3")
def slowest_labels(spark, sf):
    return logs.label_stats(logs.spans(T.log_lines(spark, sf)), "max").limit(3).select("label", "layer", "max_micros")


_ORDER = ["l_partkey", "l_suppkey", "l_extendedprice", "length"]


@query("ag24_superseded_bytes", f"WITH {S.LATEST} SELECT (SELECT count(*) FROM idx) - count(*) AS superseded, CAST((SELECT sum(length) FROM idx) - sum(length) AS BIGINT) AS superseded_bytes FROM latest")
def superseded_bytes(spark, sf):
    return index.superseded_bytes(T.index_entries(spark, sf), _ORDER)


@query("ag23_pack_sizes", f"WITH {S.LATEST} SELECT pack, CAST(sum(length) AS BIGINT) AS bytes, count(*) AS objects FROM latest GROUP BY pack")
def pack_sizes(spark, sf):
    """Packs of each writer, summed up again: packing neither loses nor repeats an object."""
    rows = index.packed(_latest(spark, sf).select("hash", "pack", "length"), "pack", "hash")
    sizes = index.pack_sizes(rows, "pack").select("pack", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b).alias("bytes"))
    return sizes.join(rows.groupBy("pack").agg(F.count("*").alias("objects")), "pack")


@query("ch06_is_chunked", f"WITH {S.FILES} SELECT path FROM files WHERE contains(text, chr(10))")
def is_chunked(spark, sf):
    return chunks.manifests(chunks.line_chunks(T.blobs(spark, sf))).where("is_chunked").select("path")


@query(
    "pk12_resolve",
    f"WITH {S.FILES}, e AS (SELECT DISTINCT sha256(text) AS hash, encode(text) AS body FROM files), k AS (SELECT hash, body, CASE octet_length(body) % 3 WHEN 0 THEN 'inline' WHEN 1 THEN 'pack' ELSE 'standalone' END AS kind FROM e) SELECT hash, CASE WHEN kind <> 'standalone' THEN hex(body) END AS bytes FROM k",
)
def resolve(spark, sf):
    """Entries of all files and kinds, at several offsets, to all their bytes."""
    body = F.encode("text", "UTF-8")
    files = T.blobs(spark, sf).select(sha(body).alias("hash"), body.alias("body"), "size").dropDuplicates(["hash"])
    kind = F.when(F.col("size") % 3 == 0, "inline").when(F.col("size") % 3 == 1, "pack").otherwise("standalone")
    files = files.select("*", kind.alias("kind"), (F.col("size") % 7).alias("offset"))
    head = F.encode(F.expr("substring('headers', 1, cast(offset as int))"), "UTF-8")
    packs = files.where("kind = 'pack'").select(F.col("hash").alias("pack_hash"), F.concat(F.unhex(F.lit("EDE1")), head, "body", F.encode(F.lit("tail"), "UTF-8")).alias("bytes"))
    entries = files.select("hash", "kind", F.when(F.col("kind") == "inline", F.col("body")).alias("data"), F.col("hash").alias("pack_hash"), "offset", F.col("size").alias("length"))
    return index.resolve(entries, packs).select("hash", F.hex("bytes").alias("bytes"))


@query("lm08_releasable", f"WITH {S.LOGS}, n AS (SELECT conv_id, max(n) AS n FROM logs GROUP BY conv_id) SELECT CAST(conv_id AS VARCHAR) AS path FROM n WHERE (SELECT count(*) FROM n WHERE n >= 3) = 0")
def releasable(spark, sf):
    merged = merge3.merged_files(_three_files(spark, sf, rewrite=True))
    return merge3.releasable(merged, merged.select("path")).select("path")


@query("lm08_released", f"WITH {S.LOGS} SELECT DISTINCT CAST(conv_id AS VARCHAR) AS path FROM logs")
def released(spark, sf):
    merged = merge3.merged_files(_three_files(spark, sf))
    return merge3.releasable(merged, merged.select("path")).select("path")


@query("sc29_truncate", "SELECT doc_id, substr(coalesce(text, ''), 1, 12) AS start, substr(sha256(coalesce(text, '')), 1, 8) AS short FROM documents")
def truncated(spark, sf):
    return T.blobs(spark, sf).select("doc_id", truncate(F.col("text"), 12).alias("start"), abbreviate(sha(F.encode("text", "UTF-8"))).alias("short"))


@query("sc31_stub_names", f"WITH {S.FILES} SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN path WHEN 1 THEN 'docs/' || lang || '/' || source END AS logical FROM files")
def stub_names(spark, sf):
    p, k = F.col("path"), F.col("doc_id") % 3
    given = F.when(k == 0, F.concat(p, F.lit(".snap-stub"))).when(k == 1, F.concat(F.regexp_extract(p, "^(.*)/", 1), F.lit("/.snap-stub"))).otherwise(p)
    return T.blobs(spark, sf).select("doc_id", stub_logical(given).alias("logical"))


@query("sc39_inspect_index", f"WITH {S.LATEST} SELECT '{{\"hash\":\"' || hash || '\",\"kind\":\"' || kind || '\",\"length\":' || CAST(length AS VARCHAR) || '}}' AS json FROM latest")
def inspect_index(spark, sf):
    """Every latest entry as JSON."""
    return stats.to_report(_latest(spark, sf).select("hash", "kind", "length"))


@query("st08_known_keys", f"WITH {S.LATEST} SELECT hash, CASE WHEN kind = 'pack' THEN 'pack' ELSE 'other' END AS class FROM latest")
def known_keys(spark, sf):
    entries = _latest(spark, sf)
    known = entries.where("kind = 'pack'").select(F.col("hash").alias("key"), F.lit("pack").alias("class"), F.lit(0).alias("priority")).unionByName(entries.select(F.col("hash").alias("key"), F.lit("other").alias("class"), F.lit(1).alias("priority")))
    return stats.classify_listing(entries.select(F.col("hash").alias("key"), F.col("length").alias("size")), known).select(F.col("key").alias("hash"), "class")
