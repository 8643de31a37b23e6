"""DuckDB views of the derived relations, as common table expressions for the oracle queries."""

FILES = """files AS (
  SELECT doc_id, 'docs/' || lang || '/' || source || '/' || lpad(CAST(doc_id AS VARCHAR), 7, '0') || '.txt' AS path, lang, source,
         coalesce(text, '') AS text, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size,
         CASE WHEN doc_id % 17 = 0 THEN '755' END AS mode, 1700000000 + doc_id * 60 AS mtime_secs, doc_id % 40 AS m
  FROM documents)"""


def _state(name: str, gone: str, text: str, mode: str = "mode") -> str:
    return f"""{name} AS (
  SELECT path, sha256('\\xED\\xF0'::BLOB || encode(new_text)) AS hash, CAST(octet_length(encode(new_text)) AS BIGINT) AS size, new_mode AS mode, mtime_secs
  FROM (SELECT *, {text} AS new_text, {mode} AS new_mode FROM files) WHERE m NOT IN ({gone}))"""


BASE = _state("base", "3, 4, 6, 8", "text")
LOCAL = _state(
    "local", "4, 5, 7, 9", "text || CASE WHEN m IN (10, 11, 12, 13) THEN ' [L]' WHEN m = 14 THEN ' [S]' ELSE '' END",
    "CASE WHEN m IN (15, 16) THEN CASE WHEN mode IS NULL THEN '755' END ELSE mode END",
)
REMOTE = _state("remote", "3, 5, 12, 20", "text || CASE WHEN m IN (8, 9, 11, 16, 18, 19) THEN ' [R]' WHEN m = 14 THEN ' [S]' ELSE '' END")


def diffed(name: str, base: str, target: str, with_mode: bool = True) -> str:
    mode = "OR t.mode IS DISTINCT FROM b.mode" if with_mode else ""
    return f"""{name} AS (
  SELECT coalesce(b.path, t.path) AS path, CASE WHEN b.path IS NULL THEN 'A' WHEN t.path IS NULL THEN 'D' ELSE 'M' END AS change,
         b.hash AS base_hash, t.hash AS target_hash, b.mode AS base_mode, t.mode AS target_mode, t.size AS target_size, b.size AS base_size,
         t.mtime_secs AS target_mtime_secs
  FROM {base} b FULL JOIN {target} t ON b.path = t.path
  WHERE b.path IS NULL OR t.path IS NULL OR b.hash <> t.hash {mode})"""


SNAPSHOTS = f"{FILES}, {BASE}, {LOCAL}, {REMOTE}"
CHANGES = f"{SNAPSHOTS}, {diffed('ours', 'base', 'local')}, {diffed('theirs', 'base', 'remote')}"
THREE_WAY = f"""{CHANGES}, outcomes AS (
  SELECT coalesce(o.path, t.path) AS path, o.change AS local_change, t.change AS remote_change,
         CASE WHEN o.path IS NULL THEN 'clean' WHEN t.path IS NULL THEN 'kept'
              WHEN (o.change = 'D' AND t.change = 'D') OR o.target_hash = t.target_hash THEN 'clean' ELSE 'conflict' END AS outcome
  FROM ours o FULL JOIN theirs t ON o.path = t.path)"""

IO = """io AS (
  SELECT event_id AS line_no, ts, event_type AS cmd, 'r' || CAST(user_id % 3 AS VARCHAR) AS remote, event_id % 5 AS exists_found, event_id % 3 AS exists_miss,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS writes, CAST(floor(value * 1000) AS BIGINT) AS write_bytes, user_id % 7 AS reads,
         user_id % 7 * 512 AS read_bytes, event_id % 4 AS deltas_merged, user_id * 100 AS orphaned_bytes
  FROM events)"""

LINES = """lines AS (
  SELECT user_id AS file, event_id AS line_no, event_type AS label,
         CASE event_type WHEN 'click' THEN 'L1' WHEN 'view' THEN 'L1' WHEN 'purchase' THEN 'L6' WHEN 'scroll' THEN 'L7' WHEN 'login' THEN 'L2' ELSE 'L7' END AS layer,
         CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'scroll' THEN 2 ELSE 1 END AS depth,
         CASE WHEN event_id % 2 = 0 THEN 'start' ELSE 'end' END AS kind,
         epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS micros
  FROM events)"""

SPANS = f"""{LINES}, r1 AS (
  SELECT *, sum(CASE kind WHEN 'start' THEN 1 ELSE -1 END) OVER w AS s FROM lines WINDOW w AS (PARTITION BY file, depth, label, layer ORDER BY line_no ROWS UNBOUNDED PRECEDING)
), r2 AS (
  SELECT *, s - least(0, min(s) OVER (PARTITION BY file, depth, label, layer ORDER BY line_no ROWS UNBOUNDED PRECEDING)) AS height FROM r1
), r3 AS (
  SELECT *, coalesce(lag(height) OVER (PARTITION BY file, depth, label, layer ORDER BY line_no), 0) AS before FROM r2
), r4 AS (
  SELECT *, CASE WHEN kind = 'start' THEN height WHEN before >= 1 THEN before END AS level FROM r3
), spans AS (
  SELECT file, label, layer, depth, start_micros, micros AS end_micros FROM (
    SELECT *, last_value(CASE WHEN kind = 'start' THEN micros END IGNORE NULLS) OVER (PARTITION BY file, depth, label, layer, level ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start_micros
    FROM r4 WHERE level IS NOT NULL) WHERE kind = 'end')"""

INDEX = """idx AS (
  SELECT *, CASE WHEN length < 256 THEN 'inline' WHEN length < 1048576 THEN 'pack' ELSE 'standalone' END AS kind FROM (
    SELECT sha256(CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)) AS hash, l_suppkey % 4 AS generation,
           CAST(CASE WHEN l_suppkey % 10 = 0 THEN floor(l_quantity) ELSE floor(l_extendedprice * 10) END AS BIGINT) AS length,
           'p' || CAST(l_partkey % 97 AS VARCHAR) AS pack, l_partkey, l_suppkey, l_extendedprice FROM lineitem))"""
LATEST = f"""{INDEX}, latest AS (
  SELECT hash, kind, length, pack, generation FROM (
    SELECT *, row_number() OVER (PARTITION BY hash ORDER BY generation DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, length DESC) AS rn FROM idx) WHERE rn = 1)"""

URLS = """urls AS (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/+$', '') AS path FROM pages)"""
LOGS = """logs AS (
  SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n,
         ': ' || CAST(1000 + turn * 10 AS VARCHAR) || ':0;' || replace(coalesce(text, ''), chr(10), ' ') AS line FROM conversations)"""
#: All ancestor directories of ``path`` (root: empty), as a list.
ANCESTORS = "list_concat([''], list_transform(range(1, len(string_split(path, '/'))), lambda n: array_to_string(list_slice(string_split(path, '/'), 1, n), '/')))"
BUCKET = "CASE WHEN size >= 16777216 THEN 9 WHEN size >= 4194304 THEN 8 WHEN size >= 1048576 THEN 7 WHEN size >= 262144 THEN 6 WHEN size >= 65536 THEN 5 WHEN size >= 16384 THEN 4 WHEN size >= 4096 THEN 3 WHEN size >= 1024 THEN 2 WHEN size >= 256 THEN 1 ELSE 0 END"
LABELS = "['<256B', '256B-1KB', '1-4KB', '4-16KB', '16-64KB', '64-256KB', '256KB-1MB', '1-4MB', '4-16MB', '>16MB']"
