"""Registered queries of this subpackage: (name, query, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The vocabulary of the tokenisation queries; never copied into the repository.
BYTE_BPE = "byte_bpe_50k.json"


def vocabulary_path(name: str = BYTE_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return add


@query("op2_token_files")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treeline.llm.token_files import token_files

    return token_files(table(spark, sf_dir, "documents"), vocabulary_path(), end_id=2)


@query("op5_bpe_trie")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treeline.llm.bpe_trie import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), vocabulary_path(), digests_only=True)


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treeline.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary_path(), limit=1024)


@query("op3_line_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treeline.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents"), min_docs=3, min_chars=20, digests_only=True)


@query("op10_warc")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treeline.llm.warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages"))


ORACLE["op3_line_dedup"] = r"""
WITH d AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM d
), f AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), j AS (
  SELECT k.doc_id, k.line, k.pos, f.keeper IS NOT NULL AND f.keeper <> k.doc_id AS gone
  FROM k LEFT JOIN f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

ORACLE["op10_warc"] = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 100
"""


#: The rules of the URL query.
URL_RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


@query("op4_quality_ratio")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treeline.llm.quality import judge_quality

    judged = judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op7_url_cascade")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treeline.llm.url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


ORACLE["op7_url_cascade"] = r"""
WITH r(rule_host, rule_path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), s AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s
), m AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id
)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""


@query("op1_decontaminate")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treeline.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op1_decontaminate"] = r"""
WITH t AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark
), w AS (
  SELECT side, id, list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^\pL\pN\x20\x09-\x0D]+', '', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t
), s AS (
  SELECT DISTINCT side, id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM (SELECT side, id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
), n AS (SELECT id, count(*) AS n FROM s WHERE side = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared, any_value(n.n) AS n_shingles
FROM s d JOIN s i ON d.s = i.s AND d.side = 'd' AND i.side = 'i' JOIN n ON n.id = i.id
GROUP BY d.id, i.id HAVING count(*) >= 0.8 * any_value(n.n)
"""


@query("op8_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treeline.llm.near_dedup import near_duplicate_classes

    return near_duplicate_classes(table(spark, sf_dir, "documents"))


@query("op9_lbl_scores")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treeline.llm.lbl import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))
