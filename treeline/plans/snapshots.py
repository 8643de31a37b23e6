"""Plans over snapshots: diffs, three-way classification, roll-ups, caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from treeline.functions.globs import is_pruned, rules_match
from treeline.operators import cache, diff, graph, rollup
from treeline.plans import sql as S
from treeline.plans.registry import query
from treeline.sources.tables import snapshot


def sides(spark, sf):
    return (snapshot(spark, sf, name) for name in ("base", "local", "remote"))


_DIFF = ("path", "change", "base_hash", "target_hash", "base_mode", "target_mode")


@query("jn01_local_diff", f"WITH {S.CHANGES} SELECT path, change, base_hash, target_hash, base_mode, target_mode FROM ours")
def local_diff(spark, sf):
    base, local, _ = sides(spark, sf)
    return diff.diff(base, local).select(*_DIFF)


@query("jn02_remote_diff", f"WITH {S.CHANGES} SELECT path, change, target_hash AS hash, base_size, target_size, CASE change WHEN 'A' THEN 'added' WHEN 'M' THEN 'modified' ELSE 'deleted' END AS label FROM theirs")
def remote_diff(spark, sf):
    base, _, remote = sides(spark, sf)
    return diff.diff(base, remote).select("path", "change", F.col("target_hash").alias("hash"), "base_size", "target_size", diff.label(F.col("change")).alias("label"))


@query("jn02_diff_content_only", f"WITH {S.SNAPSHOTS}, {S.diffed('d', 'base', 'local', False)} SELECT path, change FROM d")
def content_diff(spark, sf):
    base, local, _ = sides(spark, sf)
    return diff.diff(base, local, with_mode=False).select("path", "change")


@query(
    "jn03_remote_status",
    f"""WITH {S.CHANGES} SELECT path, change AS status FROM theirs
    UNION ALL SELECT DISTINCT unnest({S.ANCESTORS}) AS path, 'M' AS status FROM theirs""",
)
def remote_status(spark, sf):
    base, _, remote = sides(spark, sf)
    changes = diff.diff(base, remote).select("path", F.col("change").alias("status"))
    return changes.unionByName(diff.directory_status(changes))


@query("jn04_three_way", f"WITH {S.THREE_WAY} SELECT * FROM outcomes")
def three_way(spark, sf):
    return diff.three_way(*sides(spark, sf))


@query("jn04_outcome_counts", f"WITH {S.THREE_WAY} SELECT local_change, remote_change, outcome, count(*) AS n FROM outcomes GROUP BY ALL")
def outcome_counts(spark, sf):
    return diff.three_way(*sides(spark, sf)).groupBy("local_change", "remote_change", "outcome").agg(F.count("*").alias("n"))


@query("jn05_preserved", f"WITH {S.CHANGES} SELECT path, change FROM ours WHERE path NOT IN (SELECT path FROM theirs)")
def preserved(spark, sf):
    base, local, remote = sides(spark, sf)
    return diff.preserved(diff.diff(base, local), diff.diff(base, remote)).select("path", "change")


@query("jn06_deletions", f"WITH {S.SNAPSHOTS} SELECT path, hash, size FROM base WHERE path NOT IN (SELECT path FROM remote)")
def deletions(spark, sf):
    base, _, remote = sides(spark, sf)
    return diff.deletions(base, remote).select("path", "hash", "size")


@query("jn09_stable_times", f"WITH {S.SNAPSHOTS} SELECT l.path, l.hash, CASE WHEN l.hash = b.hash THEN b.mtime_secs ELSE l.mtime_secs + 7 END AS mtime_secs FROM local l LEFT JOIN base b USING (path)")
def stable_times(spark, sf):
    base, local, _ = sides(spark, sf)
    return cache.stable_times(local.withColumn("mtime_secs", F.col("mtime_secs") + 7), base).select("path", "hash", "mtime_secs")


@query("jn14_overlay", f"WITH {S.SNAPSHOTS} SELECT path, hash FROM local UNION ALL SELECT path, hash FROM remote WHERE path NOT IN (SELECT path FROM local)")
def overlay(spark, sf):
    _, local, remote = sides(spark, sf)
    return diff.overlay(local, remote).select("path", "hash")


@query(
    "jn15_around_stubs",
    f"""WITH {S.SNAPSHOTS}, stubs AS (SELECT DISTINCT 'docs/' || lang || '/' || source AS stub FROM documents WHERE doc_id % 200 = 7),
    dirs AS (SELECT DISTINCT unnest({S.ANCESTORS}) AS path FROM base), alls AS (SELECT path FROM base UNION ALL SELECT path FROM dirs WHERE path <> '')
    SELECT path, EXISTS (SELECT 1 FROM stubs WHERE path = stub OR starts_with(path, stub || '/')) AS at_or_under,
           EXISTS (SELECT 1 FROM stubs WHERE starts_with(stub, path || '/')) AS above FROM alls""",
)
def around_stubs(spark, sf):
    from treeline.functions.paths import ancestors, parent
    from treeline.sources.tables import blobs

    base, _, _ = sides(spark, sf)
    dirs = base.select(F.explode(ancestors(F.col("path"), with_root=False)).alias("path")).distinct()
    stubs = blobs(spark, sf).where("doc_id % 200 = 7").select(parent(F.col("path")).alias("path"))
    return diff.marked_around(base.select("path").unionByName(dirs), stubs)


@query("jn19_splice", f"WITH {S.SNAPSHOTS} SELECT path, hash FROM base WHERE NOT starts_with(path, 'docs/en/src1/') UNION ALL SELECT path, hash FROM remote WHERE starts_with(path, 'docs/en/src1/')")
def splice(spark, sf):
    base, _, remote = sides(spark, sf)
    return diff.splice(base, "docs/en/src1", remote.where(F.col("path").startswith("docs/en/src1/"))).select("path", "hash")


@query("jn20_remove", f"WITH {S.SNAPSHOTS} SELECT path, hash FROM base WHERE NOT starts_with(path, 'docs/de/')")
def remove(spark, sf):
    base, _, _ = sides(spark, sf)
    return diff.splice(base, "docs/de", base.limit(0)).select("path", "hash")


@query(
    "jn21_restore_plan",
    f"""WITH {S.SNAPSHOTS} SELECT coalesce(b.path, l.path) AS path, CASE WHEN b.path IS NULL THEN 'delete' WHEN l.path IS NULL OR b.hash <> l.hash
    OR b.mode IS DISTINCT FROM l.mode THEN 'restore' ELSE 'skip' END AS action FROM base b FULL JOIN local l ON b.path = l.path""",
)
def restore_plan(spark, sf):
    base, local, _ = sides(spark, sf)
    return diff.restore_plan(base, local)


@query(
    "ag28_restore_counts",
    f"""WITH {S.SNAPSHOTS} SELECT CASE WHEN b.path IS NULL THEN 'delete' WHEN l.path IS NULL OR b.hash <> l.hash
    OR b.mode IS DISTINCT FROM l.mode THEN 'restore' ELSE 'skip' END AS action, count(*) AS n FROM base b FULL JOIN local l ON b.path = l.path GROUP BY 1""",
)
def restore_counts(spark, sf):
    base, local, _ = sides(spark, sf)
    return diff.restore_plan(base, local).groupBy("action").agg(F.count("*").alias("n"))


@query(
    "jn22_reconcile_stubs",
    f"""WITH {S.FILES}, stubs AS (SELECT path, CASE WHEN m % 2 = 0 THEN 'file' ELSE 'dir' END AS stub_kind FROM files WHERE m < 24),
    kinds AS (SELECT path, CASE WHEN m % 3 = 0 THEN 'blob' WHEN m % 3 = 1 THEN 'tree' ELSE 'symlink' END AS base_kind FROM files WHERE m BETWEEN 6 AND 30)
    SELECT path, stub_kind, base_kind, CASE WHEN (base_kind = 'blob' AND stub_kind = 'file') OR (base_kind = 'tree' AND stub_kind = 'dir') THEN 'update'
      WHEN base_kind = 'blob' THEN 'to_file_stub' WHEN base_kind = 'tree' THEN 'to_dir_stub' WHEN base_kind = 'symlink' THEN 'create_symlink' ELSE 'remove' END AS action
    FROM stubs LEFT JOIN kinds USING (path)""",
)
def reconcile_stubs(spark, sf):
    from treeline.sources.tables import blobs

    files = blobs(spark, sf).withColumn("m", F.col("doc_id") % 40)
    stubs = files.where("m < 24").select("path", F.when(F.col("m") % 2 == 0, "file").otherwise("dir").alias("stub_kind"))
    kinds = files.where("m between 6 and 30").select("path", F.when(F.col("m") % 3 == 0, "blob").when(F.col("m") % 3 == 1, "tree").otherwise("symlink").alias("kind"))
    return diff.reconcile_stubs(stubs, kinds)


@query("jn23_row_source", f"WITH {S.SNAPSHOTS} SELECT b.path, coalesce(r.hash, b.hash) AS hash, coalesce(r.size, b.size) AS size FROM base b LEFT JOIN remote r USING (path)")
def row_source(spark, sf):
    base, _, remote = sides(spark, sf)
    chosen = remote.select("path", F.col("hash").alias("h"), F.col("size").alias("s"))
    return base.join(chosen, "path", "left").select("path", F.coalesce("h", "hash").alias("hash"), F.coalesce("s", "size").alias("size"))


@query(
    "jn24_unknown_status",
    f"""WITH {S.CHANGES}, alls AS (SELECT b.path, o.change AS status FROM base b LEFT JOIN ours o USING (path) UNION ALL
      SELECT DISTINCT unnest({S.ANCESTORS}) AS path, NULL AS status FROM base)
    SELECT path, CASE WHEN path = 'docs/fr/src2' OR starts_with(path, 'docs/fr/src2/') OR (status IS NULL AND path IN ('', 'docs', 'docs/fr')) THEN '?' ELSE status END AS status FROM alls""",
)
def unknown_status(spark, sf):
    from treeline.functions.paths import ancestors

    base, local, _ = sides(spark, sf)
    rows = base.select("path").join(diff.diff(base, local).select("path", F.col("change").alias("status")), "path", "left")
    dirs = base.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct().withColumn("status", F.lit(None).cast("string"))
    return diff.unknown_status(rows.unionByName(dirs), spark.createDataFrame([("docs/fr/src2",)], "path string"))


@query("jn25_preserve_unstable", f"WITH {S.SNAPSHOTS}, u AS (SELECT path FROM files WHERE m % 9 = 4) SELECT path, hash FROM local WHERE path NOT IN (SELECT path FROM u) UNION ALL SELECT path, hash FROM base WHERE path IN (SELECT path FROM u)")
def preserve_unstable(spark, sf):
    from treeline.sources.tables import blobs

    base, local, _ = sides(spark, sf)
    unstable = blobs(spark, sf).where("doc_id % 40 % 9 = 4").select("path")
    return cache.preserve_unstable(local, unstable, base).select("path", "hash")


@query(
    "jn26_added_rolled_up",
    f"""WITH {S.CHANGES}, a AS (SELECT 'docs/' || split_part(path, '/', 2) AS child, path FROM ours WHERE change = 'A'),
    listing AS (SELECT DISTINCT 'docs/' || split_part(path, '/', 2) AS child FROM base WHERE split_part(path, '/', 2) IN ('en', 'de'))
    SELECT child AS path, 'M' AS status, count(*) AS n_added FROM a WHERE child NOT IN (SELECT child FROM listing) GROUP BY child""",
)
def added_rolled_up(spark, sf):
    from treeline.functions.paths import child_of_scope

    base, local, _ = sides(spark, sf)
    listing = base.select(child_of_scope(F.col("path"), "docs").alias("path")).distinct().where("path in ('docs/en', 'docs/de')")
    return diff.added_not_listed(diff.diff(base, local).where("change = 'A'"), listing, "docs")


@query("jn27_remote_added", f"WITH {S.CHANGES} SELECT path, target_size AS size FROM theirs WHERE change = 'A' AND path NOT IN (SELECT path FROM local)")
def remote_added(spark, sf):
    base, local, remote = sides(spark, sf)
    return diff.diff(base, remote).where("change = 'A'").join(local.select("path"), "path", "left_anti").select("path", F.col("target_size").alias("size"))


RULES = {"": ["/docs/es", "*5.txt", "!*15.txt"], "docs/en": ["src1*", "!src12"]}
_IGNORED = """(starts_with(path, 'docs/es/') OR (regexp_matches(path, '5\\.txt$') AND NOT regexp_matches(path, '15\\.txt$'))
  OR (regexp_matches(path, '^docs/en/src1[^/]*/') AND NOT starts_with(path, 'docs/en/src12/')))"""


@query("jn28_ignored_rows", f"WITH {S.SNAPSHOTS} SELECT l.path, CASE WHEN b.path IS NULL THEN 'I' ELSE 'i' END AS z, CASE WHEN b.path IS NOT NULL THEN 'D' END AS status FROM (SELECT path FROM local WHERE {_IGNORED}) l LEFT JOIN base b USING (path)")
def ignored_rows(spark, sf):
    base, local, _ = sides(spark, sf)
    return diff.ignored_rows(local.where(is_pruned(F.col("path"), RULES)), base)


@query("prd07_pruned_paths", f"WITH {S.SNAPSHOTS} SELECT path, {_IGNORED} AS ignored FROM base")
def pruned_paths(spark, sf):
    base, _, _ = sides(spark, sf)
    return base.select("path", is_pruned(F.col("path"), RULES).alias("ignored"))


@query(
    "prd05_rule_files",
    f"WITH {S.SNAPSHOTS} SELECT path, (regexp_matches(path, '5\\.txt$') AND NOT regexp_matches(path, '15\\.txt$')) AS matched FROM base",
)
def rule_files(spark, sf):
    base, _, _ = sides(spark, sf)
    return base.select("path", rules_match(F.col("path"), RULES).alias("matched"))


@query("jn30_fetch_plan", f"WITH {S.CHANGES} SELECT hash, size FROM (SELECT target_hash AS hash, min(target_size) AS size FROM theirs WHERE change <> 'D' AND target_size < 2000 GROUP BY 1) WHERE hash NOT IN (SELECT hash FROM local)")
def fetch_plan(spark, sf):
    base, local, remote = sides(spark, sf)
    return diff.fetch_plan(diff.diff(base, remote), local, 2000)


_CONFLICTS = f"""{S.THREE_WAY}, conflicts AS (
  SELECT c.path, local_change, remote_change, b.hash AS base_hash, b.mode AS base_mode, b.mtime_secs AS base_mtime_secs, l.hash AS local_hash, l.mode AS local_mode,
         l.mtime_secs AS local_mtime_secs, r.hash AS remote_hash, r.mode AS remote_mode, r.mtime_secs AS remote_mtime_secs
  FROM outcomes c LEFT JOIN base b USING (path) LEFT JOIN local l USING (path) LEFT JOIN remote r USING (path) WHERE outcome = 'conflict')"""


@query("snk09_conflict_rows", f"WITH {_CONFLICTS} SELECT * FROM conflicts")
def conflict_rows(spark, sf):
    return diff.conflict_rows(*sides(spark, sf))


@query("jn33_accept_remote", f"WITH {_CONFLICTS} SELECT path, CASE WHEN remote_hash IS NULL THEN 'delete' ELSE 'write' END AS action, remote_hash AS hash, remote_mode AS mode FROM conflicts")
def accept_remote(spark, sf):
    return diff.accept(diff.conflict_rows(*sides(spark, sf)), "remote")


@query("snk10_apply_diff", f"WITH {S.SNAPSHOTS} SELECT path, hash, size, mode FROM remote")
def apply_diff(spark, sf):
    base, _, remote = sides(spark, sf)
    return diff.apply_changes(base, diff.diff(base, remote)).select("path", "hash", "size", "mode")


@query(
    "gr07_collapsed_trees",
    f"""WITH {S.SNAPSHOTS}, old AS (SELECT path FROM base WHERE NOT starts_with(path, 'docs/es/') AND NOT starts_with(path, 'docs/en/src3/')),
    added AS (SELECT path, size FROM base WHERE path NOT IN (SELECT path FROM old)),
    big AS (SELECT 'docs/es' AS dir, sum(size) AS size, count(*) AS n FROM added WHERE starts_with(path, 'docs/es/') UNION ALL
            SELECT 'docs/en/src3', sum(size), count(*) FROM added WHERE starts_with(path, 'docs/en/src3/'))
    SELECT dir AS path, CAST(size AS BIGINT) AS size, n AS blob_count, true AS is_stub FROM big WHERE n > 0""",
)
def collapsed_trees(spark, sf):
    base, _, _ = sides(spark, sf)
    p = F.col("path")
    old = base.where(~p.startswith("docs/es/") & ~p.startswith("docs/en/src3/"))
    return diff.collapse_added_trees(base.join(old.select("path"), "path", "left_anti"), old, 1)


@query("gr07_expand_or_stub", f"WITH {S.SNAPSHOTS} SELECT path, size, size >= 2000 AND path <> 'docs/en/src0/0000000.txt' AS is_stub FROM base")
def expand_or_stub(spark, sf):
    base, _, _ = sides(spark, sf)
    return graph.expand_or_stub(base, 2000, ["docs/en/src0/0000000.txt"]).select("path", "size", "is_stub")


@query(
    "ag01_directory_totals",
    f"WITH {S.SNAPSHOTS} SELECT path, CAST(sum(size) AS BIGINT) AS size, count(*) AS blob_count, max(mtime_secs) AS mtime_secs FROM (SELECT unnest({S.ANCESTORS}) AS path, size, mtime_secs FROM base) GROUP BY path",
)
def directory_totals(spark, sf):
    base, _, _ = sides(spark, sf)
    return rollup.directory_totals(base)


_ENTRY = "'{{\"kind\":\"{kind}\",\"name\":\"' || name || '\",\"hash\":\"' || hash || '\",\"size\":' || CAST(size AS VARCHAR) || CASE WHEN mode IS NULL THEN '' ELSE ',\"mode\":\"' || mode || '\"' END || '}}'"


def _level(name: str, source: str, kind: str) -> str:
    return f"""{name} AS (
  SELECT dir, sha256('\\xED\\xF1'::BLOB || encode('{{"kind":"normal","entries":[' || string_agg({_ENTRY.format(kind=kind)}, ',' ORDER BY name) || ']}}')) AS hash, CAST(sum(size) AS BIGINT) AS size
  FROM ({source}) GROUP BY dir)"""


_UP = "SELECT regexp_extract(dir, '^(.*?)/?[^/]*$', 1) AS dir, regexp_extract(dir, '([^/]*)$', 1) AS name, hash, size, CAST(NULL AS VARCHAR) AS mode FROM "


@query(
    "ag04_merkle",
    f"""WITH {S.SNAPSHOTS}, {_level('t3', "SELECT regexp_extract(path, '^(.*)/', 1) AS dir, regexp_extract(path, '([^/]*)$', 1) AS name, hash, size, mode FROM base", 'blob')},
    {_level('t2', _UP + 't3', 'tree')}, {_level('t1', _UP + 't2', 'tree')}, {_level('t0', _UP + 't1', 'tree')}
    SELECT dir AS path, hash, size FROM (SELECT * FROM t3 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t0)""",
)
def merkle(spark, sf):
    base, _, _ = sides(spark, sf)
    return rollup.merkle(base)


@query("ag20_directory_status", f"WITH {S.CHANGES} SELECT DISTINCT unnest({S.ANCESTORS}) AS path, 'M' AS status FROM ours")
def directory_status(spark, sf):
    base, local, _ = sides(spark, sf)
    return diff.directory_status(diff.diff(base, local))


NOW = 1700030000
_CACHE = f"""{S.SNAPSHOTS}, cache AS (SELECT path, size AS fs_size, mtime_secs, hash, mtime_secs % 7 = 0 AS is_unsafe FROM base WHERE mtime_secs % 5 <> 1)"""


def _cache(base):
    return base.where("mtime_secs % 5 <> 1").select("path", F.col("size").alias("fs_size"), "mtime_secs", F.lit(0).alias("mtime_nanos"), "hash", (F.col("mtime_secs") % 7 == 0).alias("is_unsafe"))


@query(
    "jn07_hash_source",
    f"""WITH {_CACHE} SELECT l.path, CASE WHEN c.path IS NOT NULL THEN 'cache' WHEN b.size = l.size AND b.mtime_secs = l.mtime_secs AND {NOW} - l.mtime_secs >= 3 THEN 'base' ELSE 'read' END AS source,
    CASE WHEN c.path IS NOT NULL THEN c.hash WHEN b.size = l.size AND b.mtime_secs = l.mtime_secs AND {NOW} - l.mtime_secs >= 3 THEN b.hash END AS hash
    FROM local l LEFT JOIN cache c ON l.path = c.path AND l.size = c.fs_size AND l.mtime_secs = c.mtime_secs AND NOT c.is_unsafe LEFT JOIN base b ON b.path = l.path""",
)
def hash_source(spark, sf):
    base, local, _ = sides(spark, sf)
    return cache.hash_source(local.withColumn("mtime_nanos", F.lit(0)), _cache(base), base, NOW)


@query("snk05_refreshed_rows", f"WITH {S.SNAPSHOTS} SELECT path, mtime_secs, 0 AS mtime_nanos, size AS fs_size, hash, {NOW} - mtime_secs < 3 AS is_unsafe FROM local WHERE mtime_secs % 3 <> 0")
def refreshed_rows(spark, sf):
    _, local, _ = sides(spark, sf)
    return cache.refreshed(local.withColumn("mtime_nanos", F.lit(0)).withColumn("cache_hit", F.col("mtime_secs") % 3 == 0), NOW)


@query(
    "snk04_scoped_merge",
    f"WITH {_CACHE} SELECT path, fs_size, hash FROM cache WHERE NOT starts_with(path, 'docs/de/') UNION ALL SELECT path, size AS fs_size, hash FROM local WHERE starts_with(path, 'docs/de/')",
)
def scoped_merge(spark, sf):
    base, local, _ = sides(spark, sf)
    rows = local.where(F.col("path").startswith("docs/de/")).withColumn("cache_hit", F.lit(False)).withColumn("mtime_nanos", F.lit(0))
    return cache.merge_scope(_cache(base), cache.refreshed(rows, NOW), "docs/de").select("path", "fs_size", "hash")


@query("src08_scoped_cache", f"WITH {_CACHE} SELECT path, hash FROM cache WHERE path = 'docs/en/src1' OR starts_with(path, 'docs/en/src1/')")
def scoped_cache(spark, sf):
    from treeline.functions.paths import in_scope_range

    base, _, _ = sides(spark, sf)
    return _cache(base).where(in_scope_range(F.col("path"), "docs/en/src1")).select("path", "hash")


@query("snk03_changed_rows", f"WITH {S.SNAPSHOTS} SELECT path, hash FROM local EXCEPT ALL SELECT path, hash FROM base")
def changed_rows(spark, sf):
    base, local, _ = sides(spark, sf)
    return local.select("path", "hash").exceptAll(base.select("path", "hash"))


@query("st04_names_gone", f"WITH {S.SNAPSHOTS} SELECT path FROM base EXCEPT SELECT path FROM remote")
def names_gone(spark, sf):
    base, _, remote = sides(spark, sf)
    return base.select("path").subtract(remote.select("path"))


@query("st07_distinct_content", f"WITH {S.SNAPSHOTS} SELECT hash, min(path) AS first_path, count(*) AS copies FROM base GROUP BY hash")
def distinct_content(spark, sf):
    base, _, _ = sides(spark, sf)
    return base.groupBy("hash").agg(F.min("path").alias("first_path"), F.count("*").alias("copies"))


@query("st03_hot_hashes", f"WITH {S.SNAPSHOTS} SELECT hash FROM base UNION SELECT hash FROM remote")
def hot_hashes(spark, sf):
    base, _, remote = sides(spark, sf)
    return base.select("hash").union(remote.select("hash")).distinct()


@query("snk01_put_new", f"WITH {S.SNAPSHOTS} SELECT DISTINCT hash FROM local WHERE hash NOT IN (SELECT hash FROM base)")
def put_new(spark, sf):
    from treeline.operators.index import put_new as put

    base, local, _ = sides(spark, sf)
    return put(local, base).select("hash")


@query("jn10_missing_remote", f"WITH {S.SNAPSHOTS} SELECT path, hash FROM local WHERE hash NOT IN (SELECT hash FROM remote)")
def missing_remote(spark, sf):
    from treeline.operators.index import missing

    _, local, remote = sides(spark, sf)
    return missing(local, remote).select("path", "hash")


@query(
    "lm07_eligible",
    f"WITH {S.THREE_WAY} SELECT path FROM outcomes WHERE outcome = 'conflict' AND local_change IN ('A', 'M') AND remote_change IN ('A', 'M') AND regexp_matches(path, '^docs/en/(?:.*/)?[^/]*\\.txt$')",
)
def eligible(spark, sf):
    from treeline.operators.merge3 import eligible as may_merge

    conflicts = diff.three_way(*sides(spark, sf)).where("outcome = 'conflict'")
    return may_merge(conflicts, rules_match(F.col("path"), {"docs/en": ["*.txt"]})).select("path")
