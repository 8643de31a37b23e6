"""Plans over scalars, paths, storage statistics and I/O history."""

from __future__ import annotations

from pyspark.sql import functions as F

from treeline.functions import content, formats, hashing, paths
from treeline.functions.globs import section_matches
from treeline.operators import diff, stats
from treeline.plans import sql as S
from treeline.plans.registry import query
from treeline.sources import tables as T

_BYTES = "encode(text)"


@query(
    "sc01_hashes",
    f"""WITH {S.FILES} SELECT doc_id, sha256({_BYTES}) AS plain, sha256('\\xED\\xF0'::BLOB || {_BYTES}) AS blob, sha256('\\xED\\xF3'::BLOB || {_BYTES}) AS chunk,
    sha256('\\xED\\xF1'::BLOB || encode('{{"kind":"normal","entries":[]}}')) AS empty_tree FROM files""",
)
def hashes(spark, sf):
    body = F.encode("text", "UTF-8")
    return T.blobs(spark, sf).select("doc_id", hashing.sha(body).alias("plain"), hashing.blob_hash(body).alias("blob"), hashing.chunk_hash(body).alias("chunk"), hashing.empty_tree_hash().alias("empty_tree"))


@query(
    "sc04_parse_hash",
    f"WITH {S.FILES}, h AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN upper(sha256(text)) WHEN 1 THEN sha256(text) ELSE substr(sha256(text), 1, 63) END AS h FROM files) SELECT doc_id, CASE WHEN regexp_full_match(lower(h), '[0-9a-f]{{64}}') THEN lower(h) END AS hash FROM h",
)
def parse_hash(spark, sf):
    h = hashing.sha(F.encode("text", "UTF-8"))
    given = F.when(F.col("doc_id") % 3 == 0, F.upper(h)).when(F.col("doc_id") % 3 == 1, h).otherwise(F.substring(h, 1, 63))
    return T.blobs(spark, sf).select("doc_id", hashing.parse_hash(given).alias("hash"))


@query(
    "sc05_escapes",
    f"""WITH {S.FILES}, b AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '\\xED\\xF4'::BLOB || {_BYTES} WHEN 1 THEN '\\xED\\xD1'::BLOB || {_BYTES} ELSE {_BYTES} END AS b FROM files)
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN hex('\\xED\\xF0'::BLOB || b) ELSE hex(b) END AS stored, hex(b) AS restored, doc_id % 3 = 1 AS raw_escape FROM b""",
)
def escapes(spark, sf):
    body = F.encode("text", "UTF-8")
    given = F.when(F.col("doc_id") % 3 == 0, F.concat(hashing.tag("EDF4"), body)).when(F.col("doc_id") % 3 == 1, F.concat(hashing.tag("EDD1"), body)).otherwise(body)
    rows = T.blobs(spark, sf).select("doc_id", given.alias("b")).withColumn("s", hashing.serialise_blob(F.col("b")))
    return rows.select("doc_id", F.hex("s").alias("stored"), F.hex(hashing.deserialise_blob(F.col("s"))).alias("restored"), hashing.needs_raw_escape(F.col("b")).alias("raw_escape"))


@query(
    "sc09_hash_prefix",
    f"""WITH {S.LATEST} SELECT hash, CAST(0 AS BIGINT) AS p0, CAST('0x' || substr(hash, 1, 1) AS BIGINT) // 2 AS p3, CAST('0x' || substr(hash, 1, 2) AS BIGINT) AS p8, CAST('0x' || substr(hash, 1, 3) AS BIGINT) // 4 AS p10 FROM latest""",
)
def hash_prefix(spark, sf):
    h = F.col("hash")
    return T.index_entries(spark, sf).select("hash").distinct().select("hash", *[hashing.hash_prefix(h, b).alias(f"p{b}") for b in (0, 3, 8, 10)])


_LE = lambda a: "CAST('0x' || " + " || ".join(f"substr(hash, {2 * (a + i) + 1}, 2)" for i in reversed(range(8))) + " AS UBIGINT)"
_BLOOM = f"""{S.LATEST}, bits AS (
  SELECT hash, CAST(((CAST({_LE(0)} AS HUGEINT) + i * CAST({_LE(8)} AS HUGEINT)) % 18446744073709551616) % 958506 AS BIGINT) AS bit FROM latest, (SELECT unnest(range(7)) AS i) r)"""


@query("sc10_bloom_bits", f"WITH {_BLOOM} SELECT hash, list_sort(list(bit)) AS bits FROM bits GROUP BY hash")
def bloom_bits(spark, sf):
    return T.index_entries(spark, sf).select("hash").distinct().select("hash", F.array_sort(hashing.bloom_bits(F.col("hash"), hashing.optimal_bits(100_000, 0.01))).alias("bits"))


@query(
    "sc13_content_type",
    f"""WITH {S.FILES}, b AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN '\\xFF\\xD8\\xFF'::BLOB || {_BYTES} WHEN 1 THEN '\\x1F\\x8B'::BLOB || {_BYTES} WHEN 2 THEN encode('GIF8' || text)
      WHEN 3 THEN '\\x78\\x9C'::BLOB || {_BYTES} WHEN 4 THEN '\\x28\\xB5\\x2F\\xFD'::BLOB || {_BYTES} WHEN 5 THEN '\\x01'::BLOB || {_BYTES} WHEN 6 THEN encode('%PDF' || text) ELSE encode(regexp_replace(text, '[^ -~\\n]', '', 'g')) END AS b FROM files)
    SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'gzip' WHEN 2 THEN 'gif' WHEN 3 THEN 'zlib' WHEN 4 THEN 'zstd' WHEN 5 THEN 'binary' WHEN 6 THEN 'pdf' ELSE 'text' END AS content_type FROM b""",
)
def content_types(spark, sf):
    body, k = F.encode("text", "UTF-8"), F.col("doc_id") % 8
    lead = {0: "FFD8FF", 1: "1F8B", 2: "47494638", 3: "789C", 4: "28B52FFD", 5: "01", 6: "25504446"}
    given = F.encode(F.regexp_replace("text", r"[^ -~\n]", ""), "UTF-8")
    for i, head in lead.items():
        given = F.when(k == i, F.concat(hashing.tag(head), body)).otherwise(given)
    return T.blobs(spark, sf).select("doc_id", content.content_type(given).alias("content_type"))


#: Objects of every kind and compression method: leading bytes (hex) of the stored and of the plain form, by ``doc_id % 8``.
_LEADS = {0: ("EDE0EDF1", "EDF1"), 1: ("EDF2", "EDF2"), 2: ("EDF3", "EDF3"), 3: ("EDE2", "EDE2"), 4: ("EDD0EDF1", "EDF1"), 5: ("", ""), 6: ("EDDF28B52FFD", ""), 7: ("EDDE28B52FFD", "")}
_KIND_SQL = "CASE doc_id % 8 WHEN 0 THEN 'tree' WHEN 1 THEN 'manifest' WHEN 2 THEN 'chunk' WHEN 3 THEN 'unknown' WHEN 4 THEN 'tree' ELSE 'blob' END AS kind"
_METHOD_SQL = "CASE doc_id % 8 WHEN 3 THEN NULL WHEN 4 THEN 'escaped_raw' WHEN 6 THEN 'plain_zstd' WHEN 7 THEN 'dict_zstd' ELSE 'raw' END AS method"
_OBJECTS = f"{S.FILES}, objects AS (SELECT doc_id, text, size, {_KIND_SQL}, {_METHOD_SQL}, size + CASE doc_id % 8 WHEN 0 THEN 4 WHEN 4 THEN 4 WHEN 5 THEN 0 WHEN 6 THEN 6 WHEN 7 THEN 6 ELSE 2 END AS stored FROM files)"


def _objects(spark, sf):
    body, stored = F.encode("text", "UTF-8"), F.lit(None).cast("binary")
    plain = stored
    for i, (outer, inner) in _LEADS.items():
        at = F.col("doc_id") % 8 == i
        stored = F.when(at, F.concat(hashing.tag(outer), body) if outer else body).otherwise(stored)
        plain = F.when(at, F.concat(hashing.tag(inner), body) if inner else body).otherwise(plain)
    rows = T.blobs(spark, sf).select("doc_id", stored.alias("content"), plain.alias("plain"), F.col("size").alias("logical"))
    return stats.classified(rows.withColumn("stored", F.octet_length("content").cast("long")), plain="plain")


@query("sc14_object_kinds", f"WITH {_OBJECTS} SELECT doc_id, kind, method FROM objects")
def object_kinds(spark, sf):
    return _objects(spark, sf).select("doc_id", "kind", "method")


@query(
    "sc16_format_sizes",
    f"""WITH {S.FILES}, s AS (SELECT doc_id, size * CAST(pow(64, doc_id % 4) AS BIGINT) AS n FROM files)
    SELECT doc_id, CASE WHEN n >= 1073741824 THEN printf('%.1f', n / 1073741824) || ' GiB' WHEN n >= 1048576 THEN printf('%.1f', n / 1048576) || ' MiB' WHEN n >= 1024 THEN printf('%.1f', n / 1024) || ' KiB' ELSE n || ' B' END AS long_form,
    CASE WHEN n >= 1048576 THEN printf('%.1f', n / 1048576) || ' M' WHEN n >= 1024 THEN printf('%.1f', n / 1024) || ' K' ELSE n || ' B' END AS log_form, format('{{:,}}', n) AS counted FROM s""",
)
def format_sizes(spark, sf):
    n = F.col("n")
    rows = T.blobs(spark, sf).select("doc_id", (F.col("size") * F.pow(F.lit(64), F.col("doc_id") % 4).cast("long")).alias("n"))
    return rows.select("doc_id", formats.format_size(n).alias("long_form"), formats.format_size_log(n).alias("log_form"), formats.format_count(n).alias("counted"))


@query(
    "sc18_format_durations",
    "SELECT event_id, CASE WHEN s >= 1 THEN printf('%.3f', s) || 's' WHEN s >= 0.001 THEN CAST(floor(s * 1000 + 0.5) AS BIGINT) || 'ms' ELSE CAST(floor(s * 1000000 + 0.5) AS BIGINT) || 'us' END AS took FROM (SELECT event_id, CAST(event_id AS DOUBLE) / (CASE event_id % 3 WHEN 0 THEN 64 WHEN 1 THEN 1048576 ELSE 1073741824 END) AS s FROM events)",
)
def format_durations(spark, sf):
    unit = F.when(F.col("event_id") % 3 == 0, 64).when(F.col("event_id") % 3 == 1, 1048576).otherwise(1073741824)
    return T.table(spark, sf, "events").select("event_id", formats.format_duration(F.col("event_id").cast("double") / unit).alias("took"))


@query(
    "sc19_parse_size",
    """WITH t AS (SELECT event_id, CAST(user_id AS VARCHAR) || CASE event_id % 7 WHEN 0 THEN 'K' WHEN 1 THEN 'm' WHEN 2 THEN 'G' WHEN 3 THEN '' WHEN 4 THEN 'KB' WHEN 5 THEN ' ' ELSE '.5M' END AS s, user_id FROM events)
    SELECT event_id, CAST(CASE event_id % 7 WHEN 0 THEN user_id * 1024 WHEN 1 THEN user_id * 1048576 WHEN 2 THEN user_id * 1073741824 WHEN 3 THEN user_id END AS BIGINT) AS size FROM t""",
)
def parse_sizes(spark, sf):
    k, tail = F.col("event_id") % 7, F.lit(".5M")
    for i, suffix in enumerate(["K", "m", "G", "", "KB", " "]):
        tail = F.when(k == i, suffix).otherwise(tail)
    return T.table(spark, sf, "events").select("event_id", formats.parse_size(F.concat(F.col("user_id").cast("string"), tail)).alias("size"))


@query(
    "sc20_times",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stem_time, strftime(ts, '%m-%d %H:%M:%S') AS short_time,
    CASE WHEN age >= 0 AND age < 60 THEN 'now' WHEN age >= 0 AND age < 3600 THEN CAST(age // 60 AS VARCHAR) || 'm' WHEN days BETWEEN 0 AND 14 THEN strftime(ts, '%m-%d %H:%M') ELSE strftime(ts, '%Y-%m-%d') END AS listed
    FROM (SELECT event_id, ts, 1704400000 - CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS age, date_diff('day', CAST(ts AS DATE), CAST(to_timestamp(1704400000) AT TIME ZONE 'UTC' AS DATE)) AS days FROM events)""",
)
def times(spark, sf):
    ts = F.col("ts").cast("timestamp")
    secs = F.floor(F.expr("unix_micros(cast(ts as timestamp))") / 1000000).cast("long")
    stem = F.concat(F.date_format(ts, "yyyyMMdd-HHmmss"), F.lit("-push"))
    iso = F.concat(F.date_format(ts, "yyyy-MM-dd"), F.lit("T"), F.date_format(ts, "HH:mm:ss"), F.lit("Z"))
    return T.table(spark, sf, "events").select("event_id", formats.timestamp_of_stem(stem).alias("stem_time"), formats.format_time(iso).alias("short_time"), formats.format_mtime(secs, 1704400000).alias("listed"))


@query(
    "sc24_epoch_parts",
    "SELECT event_id, CAST(floor(n / 16.0) AS BIGINT) AS secs, CAST((n % 16 + 16) % 16 * 62500000 AS INTEGER) AS nanos FROM (SELECT event_id, event_id - 5000 AS n FROM events)",
)
def epoch_parts(spark, sf):
    secs, nanos = formats.epoch_parts((F.col("event_id") - 5000) / 16.0)
    return T.table(spark, sf, "events").select("event_id", secs.alias("secs"), nanos.alias("nanos"))


@query("sc27_history_timestamp", f"WITH {S.LOGS} SELECT conv_id, turn, 1000 + turn * 10 AS at FROM logs")
def history_timestamps(spark, sf):
    return T.append_logs(spark, sf).select("conv_id", "turn", formats.history_timestamp(F.col("line")).alias("at"))


@query(
    "sc28_split_lines",
    "SELECT conv_id, turn, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, chr(10))) - CASE WHEN ends_with(t, chr(10)) THEN 1 ELSE 0 END END AS n_lines FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations)",
)
def split_lines(spark, sf):
    parts = F.split(F.coalesce("text", F.lit("")), "\n")
    lines = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return T.table(spark, sf, "conversations").select("conv_id", "turn", F.size(lines).cast("long").alias("n_lines"))


@query(
    "sc30_path_parts",
    f"WITH {S.URLS} SELECT page_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, regexp_extract(path, '([^/]*)$', 1) AS name, len(string_split(path, '/')) AS depth, regexp_extract(path, '^([^:/]*)', 1) AS ref, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^[^/]*/(.*)$', 1) END AS inner_path FROM urls",
)
def path_parts(spark, sf):
    p = F.col("path")
    ref, rest = paths.split_target(p)
    return T.url_paths(spark, sf).select("page_id", paths.parent(p).alias("parent"), paths.base_name(p).alias("name"), paths.depth(p).cast("long").alias("depth"), ref.alias("ref"), rest.alias("inner_path"))


@query("sc32_object_keys", f"WITH {S.LATEST} SELECT hash, 'objects/' || substr(hash, 1, 2) || '/' || substr(hash, 3, 2) || '/' || substr(hash, 5, 2) || '/' || substr(hash, 7) AS key, hash AS back FROM latest")
def object_keys(spark, sf):
    key = hashing.object_key(F.col("hash"))
    return T.index_entries(spark, sf).select("hash").distinct().select("hash", key.alias("key"), hashing.key_to_hash(key).alias("back"))


@query(
    "prd02_patterns",
    f"""WITH {S.URLS} SELECT page_id, regexp_matches(path, '^(?:.*/)?[^/]*25[^/]*$') AS plain, regexp_matches(path, '^blog[.][^/]*$') AS anchored, regexp_matches(path, '^(?:.*/)?en$') AS deep,
    CASE WHEN regexp_matches(path, '^(?:.*/)?[^/]*125$') THEN false ELSE regexp_matches(path, '^(?:.*/)?[^/]*25$') END AS negated FROM urls""",
)
def patterns(spark, sf):
    p = F.col("path")
    return T.url_paths(spark, sf).select("page_id", section_matches(p, ["# note", "*25*", "a?b", ""]).alias("plain"), section_matches(p, ["/blog.*"]).alias("anchored"), section_matches(p, ["**/en"]).alias("deep"), section_matches(p, ["*25", "!*125"]).alias("negated"))


@query(
    "prd09_scopes",
    f"WITH {S.SNAPSHOTS} SELECT path, (path = 'docs/en' OR starts_with(path, 'docs/en/') OR starts_with(path, 'docs/fr/src1/')) AS in_scope, regexp_matches(path, '^docs/en/src4/[^/]+$') AS direct, CASE WHEN starts_with(path, 'docs/') THEN 'docs/' || split_part(path, '/', 2) END AS child FROM base",
)
def scopes(spark, sf):
    p = F.col("path")
    return T.snapshot(spark, sf).select("path", paths.in_scope(p, ["docs/en", "docs/fr/src1"]).alias("in_scope"), paths.is_direct_child(p, "docs/en/src4").alias("direct"), paths.child_of_scope(p, "docs").alias("child"))


@query(
    "prd10_descend",
    f"WITH {S.SNAPSHOTS}, d AS (SELECT DISTINCT unnest({S.ANCESTORS}) AS path FROM base) SELECT path, (path IN ('', 'docs', 'docs/en', 'docs/en/src1') OR path = 'docs/fr' OR starts_with(path, 'docs/fr/')) AS descend FROM d",
)
def descend(spark, sf):
    dirs = T.snapshot(spark, sf).select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
    return dirs.select("path", paths.should_descend(F.col("path"), ["docs/en/src1", "docs/fr"]).alias("descend"))


@query(
    "prd13_without_covered",
    f"WITH {S.FILES}, p AS (SELECT DISTINCT CASE doc_id % 5 WHEN 0 THEN 'docs/' || lang || '/src1' WHEN 1 THEN 'docs/en' ELSE path END AS path FROM files) SELECT path FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE starts_with(a.path, b.path || '/'))",
)
def without_covered(spark, sf):
    lang = F.regexp_extract("path", "^docs/([^/]*)", 1)
    given = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("docs/"), lang, F.lit("/src1"))).when(F.col("doc_id") % 5 == 1, "docs/en").otherwise(F.col("path"))
    return diff.without_covered(T.blobs(spark, sf).select(given.alias("path")))


@query(
    "prd14_normalise",
    f"""WITH {S.FILES} SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'docs/' || lang || '/x' WHEN 1 THEN 'work/' || lang WHEN 2 THEN lang WHEN 3 THEN NULL ELSE 'a/' || lang END AS path FROM files""",
)
def normalise(spark, sf):
    lang = F.regexp_extract("path", "^docs/([^/]*)", 1)
    k = F.col("doc_id") % 5
    given = (
        F.when(k == 0, F.concat(F.lit("/docs/./"), lang, F.lit("//y/../x")))
        .when(k == 1, F.concat(F.lit("./"), lang))
        .when(k == 2, F.concat(F.lit("../"), lang))
        .when(k == 3, F.lit("../../x"))
        .otherwise(F.concat(F.lit("/b/../a/"), lang, F.lit("/")))
    )
    return T.blobs(spark, sf).select("doc_id", paths.normalise(given, "work").alias("path"))


@query(
    "prd15_reserved_names",
    f"""WITH {S.FILES} SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'helper' WHEN 1 THEN 'meta' WHEN 2 THEN 'stub' WHEN 3 THEN 'unknown' WHEN 4 THEN 'filter' END AS kind,
    CASE WHEN doc_id % 6 IN (0, 1) THEN path END AS conflict_base, CASE WHEN doc_id % 6 = 2 THEN path END AS stub_of FROM files""",
)
def reserved_names(spark, sf):
    p, k = F.col("path"), F.col("doc_id") % 6
    given = p
    for i, tail in {0: ".snap-remote", 1: ".snap-meta", 2: ".snap-stub", 3: ".snap-other"}.items():
        given = F.when(k == i, F.concat(p, F.lit(tail))).otherwise(given)
    given = F.when(k == 4, F.concat(paths.parent(p), F.lit("/.snapfilter"))).otherwise(given)
    return T.blobs(spark, sf).select("doc_id", paths.reserved_kind(given).alias("kind"), paths.conflict_base(given).alias("conflict_base"), paths.stub_logical(given).alias("stub_of"))


@query("prd19_stub_threshold", f"WITH {S.FILES} SELECT path, size >= 4096 AS is_stub, size < 4096 OR doc_id = 3 AS expanded FROM files")
def stub_threshold(spark, sf):
    from treeline.operators.graph import expand_or_stub

    files = T.blobs(spark, sf)
    third = T.blobs(spark, sf).where("doc_id = 3").select(F.col("path").alias("third"))
    marked = expand_or_stub(files, 4096).join(third, F.col("path") == F.col("third"), "left")
    return marked.select("path", "is_stub", (~F.col("is_stub") | F.col("third").isNotNull()).alias("expanded"))


@query("prd27_hash_by_prefix", f"WITH {S.LATEST} SELECT hash FROM latest WHERE starts_with(hash, '00ab')")
def hash_by_prefix(spark, sf):
    from treeline.operators.index import hash_by_prefix as find

    return find(T.index_entries(spark, sf), "00AB")


@query("prd31_modes", f"WITH {S.FILES} SELECT doc_id, CASE WHEN ((384 + doc_id % 128) & 64) <> 0 THEN '755' END AS mode FROM files")
def modes(spark, sf):
    bits = F.lit(384) + F.col("doc_id") % 128
    return T.blobs(spark, sf).select("doc_id", F.when(bits.bitwiseAND(64) != 0, "755").alias("mode"))


@query(
    "ag06_size_histogram",
    f"WITH {S.FILES}, b AS (SELECT {S.BUCKET} AS bucket, size FROM files) SELECT bucket, {S.LABELS}[bucket + 1] AS label, count(*) AS count, CAST(sum(size) AS BIGINT) AS bytes, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS count_pct, round(sum(size) * 100.0 / sum(sum(size)) OVER (), 6) AS bytes_pct FROM b GROUP BY bucket",
)
def size_histogram(spark, sf):
    found = stats.size_histogram(T.blobs(spark, sf))
    return found.withColumns({c: F.round(c, 6) for c in ("count_pct", "bytes_pct")})


@query(
    "ag08_size_stats",
    f"WITH {S.FILES} SELECT lang, count(*) AS count, CAST(sum(size) AS BIGINT) AS stored, CAST(sum(length(text)) AS BIGINT) AS logical, min(size) AS min_stored, max(size) AS max_stored, round(avg(size), 4) AS avg_stored, round(sum(size) * 100.0 / sum(length(text)), 4) AS ratio_pct, round(100 - sum(size) * 100.0 / sum(length(text)), 4) AS saved_pct FROM files GROUP BY lang",
)
def size_stats(spark, sf):
    rows = T.blobs(spark, sf).select(F.regexp_extract("path", "^docs/([^/]*)", 1).alias("lang"), F.col("size").alias("stored"), F.length("text").cast("long").alias("logical"))
    found = stats.size_stats(rows, "lang")
    return found.withColumns({c: F.round(c, 4) for c in ("avg_stored", "ratio_pct", "saved_pct")})


@query("ag11_method_totals", f"WITH {_OBJECTS} SELECT method, count(*) AS count, CAST(sum(stored) AS BIGINT) AS stored FROM objects WHERE method IS NOT NULL GROUP BY method")
def method_totals(spark, sf):
    return stats.method_totals(_objects(spark, sf))


@query("ag12_kind_totals", f"WITH {_OBJECTS} SELECT kind, count(*) AS count, CAST(sum(stored) AS BIGINT) AS stored FROM objects GROUP BY kind")
def kind_totals(spark, sf):
    return stats.kind_totals(_objects(spark, sf))


@query(
    "ag13_content_type_totals",
    f"""WITH {_OBJECTS}, heads AS (SELECT stored, size, TRY(decode(unhex(substr(hex(encode(text)), 1, 2048)))) AS head FROM objects WHERE kind = 'blob'),
    typed AS (SELECT stored, size, CASE WHEN starts_with(head, 'GIF8') THEN 'gif' WHEN starts_with(head, '%PDF') THEN 'pdf' WHEN starts_with(head, 'x^') OR starts_with(head, 'x' || chr(1)) THEN 'zlib'
      WHEN head IS NULL OR regexp_matches(head, '[\x00-\x08\x0E-\x1F]') THEN 'binary' ELSE 'text' END AS content_type FROM heads)
    SELECT content_type, count(*) AS count, CAST(sum(stored) AS BIGINT) AS stored, CAST(sum(size) AS BIGINT) AS logical, round(sum(stored) * 100.0 / sum(size), 4) AS ratio_pct FROM typed GROUP BY content_type""",
)
def content_type_totals(spark, sf):
    """Every blob by its content type."""
    return stats.content_type_totals(_objects(spark, sf)).select("content_type", "count", "stored", "logical", F.round("ratio_pct", 4).alias("ratio_pct"))


_LISTING = f"""{S.LATEST}, listing AS (SELECT hash AS key, length AS size FROM latest UNION ALL SELECT sha256('orphan-' || CAST(doc_id AS VARCHAR)) AS key, doc_id AS size FROM documents),
  known AS (SELECT hash AS key, CASE kind WHEN 'pack' THEN 'pack' WHEN 'inline' THEN 'index' ELSE 'standalone' END AS class FROM latest),
  classes AS (SELECT l.key, l.size, coalesce(k.class, 'orphan') AS class FROM listing l LEFT JOIN known k USING (key))"""


def _listing(spark, sf):
    entries = _latest(spark, sf)
    orphans = T.table(spark, sf, "documents").select(hashing.sha(F.encode(F.concat(F.lit("orphan-"), F.col("doc_id").cast("string")), "UTF-8")).alias("key"), F.col("doc_id").alias("size"))
    listing = entries.select(F.col("hash").alias("key"), F.col("length").alias("size")).unionByName(orphans)
    order = F.when(F.col("kind") == "pack", F.struct(F.lit(0).alias("priority"), F.lit("pack").alias("class"))).when(F.col("kind") == "inline", F.struct(F.lit(1).alias("priority"), F.lit("index").alias("class"))).otherwise(F.struct(F.lit(4).alias("priority"), F.lit("standalone").alias("class")))
    known = entries.select(F.col("hash").alias("key"), order.alias("k")).select("key", "k.*")
    return stats.classify_listing(listing, known.unionByName(known.withColumns({"priority": F.lit(9), "class": F.lit("root")})))


def _latest(spark, sf):
    from treeline.operators.index import latest_entries

    return latest_entries(T.index_entries(spark, sf), ["l_partkey", "l_suppkey", "l_extendedprice", "length"])


@query("jn12_classified_listing", f"WITH {_LISTING} SELECT key, size, class FROM classes")
def classified_listing(spark, sf):
    return _listing(spark, sf).select("key", "size", "class")


@query("ag14_class_totals", f"WITH {_LISTING} SELECT class, count(*) AS count, CAST(sum(size) AS BIGINT) AS bytes FROM classes GROUP BY class UNION ALL SELECT 'total', count(*), CAST(sum(size) AS BIGINT) FROM classes")
def class_totals(spark, sf):
    return stats.class_totals(_listing(spark, sf))


@query("ag15_live_bytes", f"WITH {_LISTING} SELECT CAST(greatest(sum(size) - coalesce(sum(size) FILTER (WHERE class = 'orphan'), 0), 0) AS BIGINT) AS live, CAST(coalesce(sum(size) FILTER (WHERE class = 'orphan'), 0) AS BIGINT) AS reclaimable FROM classes")
def live_bytes(spark, sf):
    return stats.live_and_reclaimable(_listing(spark, sf))


_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in stats.IO_COUNTERS)


@query("ag16_io_totals", f"WITH {S.IO} SELECT cmd, remote, count(*) AS runs, {_SUMS} FROM io GROUP BY cmd, remote")
def io_totals(spark, sf):
    return stats.io_totals(T.io_records(spark, sf), "cmd", "remote")


@query("ag17_latest_detail", f"WITH {S.IO} SELECT line_no, deltas_merged, writes AS packs_before, greatest(writes - 1, 0) AS packs_after, orphaned_bytes FROM io WHERE cmd = 'purchase' ORDER BY line_no DESC LIMIT 1")
def latest_detail(spark, sf):
    return stats.latest_detail(T.io_records(spark, sf))


@query("ag21_several_remotes", f"WITH {S.IO} SELECT count(DISTINCT remote) > 1 AS show_remote FROM io")
def several_remotes(spark, sf):
    return stats.several_remotes(T.io_records(spark, sf))


@query("wn01_recent_records", f"WITH {S.IO} SELECT line_no, cmd, writes FROM io ORDER BY ts DESC, line_no DESC LIMIT 25")
def recent_records(spark, sf):
    return stats.recent(T.io_records(spark, sf), 25).select("line_no", "cmd", "writes")


@query("wn02_nth_newest", f"WITH {S.IO} SELECT line_no, cmd FROM io ORDER BY ts DESC, line_no DESC LIMIT 1 OFFSET 6")
def nth_newest(spark, sf):
    return stats.nth_newest(T.io_records(spark, sf), 7).select("line_no", "cmd")


@query("wn05_newest_half", f"WITH {S.IO}, r AS (SELECT line_no, cmd, row_number() OVER (ORDER BY line_no DESC) AS rn, count(*) OVER () AS n FROM io) SELECT line_no, cmd FROM r WHERE rn <= n - n // 2")
def newest_half(spark, sf):
    return stats.newest_half(T.io_records(spark, sf)).select("line_no", "cmd")


@query("so12_expired_logs", "WITH f AS (SELECT strftime(ts, '%Y%m%d-%H%M%S') || '-' || event_type || '-' || CAST(event_id AS VARCHAR) AS name FROM events) SELECT name FROM (SELECT name, row_number() OVER (ORDER BY name DESC) AS rn FROM f) WHERE rn > 200")
def expired_logs(spark, sf):
    name = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd-HHmmss"), F.lit("-"), F.col("event_type"), F.lit("-"), F.col("event_id").cast("string"))
    return stats.expired(T.table(spark, sf, "events").select(name.alias("name")))


@query("snk14_json_report", f"WITH {S.IO} SELECT '{{\"remote\":\"' || remote || '\",\"runs\":' || CAST(count(*) AS VARCHAR) || ',\"writes\":' || CAST(sum(writes) AS VARCHAR) || '}}' AS json FROM io GROUP BY remote")
def json_report(spark, sf):
    return stats.to_report(stats.io_totals(T.io_records(spark, sf), "remote").select("remote", "runs", "writes"))
