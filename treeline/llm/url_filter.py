"""URL filters by a cascade of Bloom filters over the corpus's complete key universe.

A rule is a host and a path prefix (``example.com/en/``); it fits its host and all
subdomains.  A URL's keys are its host suffixes, each followed by its path cut to a
length that occurs in the rules; the universe is all keys of all URLs.  Level 1 encodes the
listed keys, level 2 the unlisted keys that pass level 1, level 3 the listed keys that
pass level 2, and so on until none passes: a key of the universe is listed iff it
passes an odd number of levels in a row.  Judging a URL thus needs neither
a join nor a shuffle.  The size follows the listed keys (the first level's rate is set
from the ratio of listed to all keys) and is checked; a list beyond ``MAX_BITS``
is matched by an equi-join on the keys instead, with the same result.

All on DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm.shared import staged

#: Bits of all levels together that are put into plans as literals (4 MiB).
MAX_BITS = 1 << 25
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: tuple[int, ...]


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level), F.lit(i), key), F.lit(bits)) for i in range(hashes)]


def _passes(key: Column, number: int, level: Level) -> Column:
    words = F.expr(f"cast(split('{','.join(map(str, level.words))}', ',') as array<bigint>)")
    found = F.lit(True)
    for at in _positions(key, number, level.bits, level.hashes):
        word = F.get(words, F.shiftright(at, 6).cast("int"))
        found = found & (F.call_function("getbit", word, at.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return found


def _build(keys: DataFrame, number: int, n: int, rate: float) -> Level:
    """A filter of the ``n`` keys of ``keys`` (column ``key``) with about this false-positive rate."""
    hashes = max(1, round(math.log2(1 / rate)))
    bits = max(64, 64 * math.ceil(n * hashes / math.log(2) / 64))
    spots = keys.select(F.explode(F.array(*_positions(F.col("key"), number, bits, hashes))).alias("at"))
    one = F.expr("shiftleft(1L, cast(at & 63 as int))")
    rows = spots.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(one).alias("bits")).collect()  # at most bits / 64 rows
    words = [0] * (bits // 64)
    for row in rows:
        words[row.word] = row.bits
    return Level(bits, hashes, tuple(words))


def cascade(universe: DataFrame, listed: DataFrame, max_bits: int = MAX_BITS) -> list[Level] | None:
    """Levels that tell the keys of ``listed`` from all others of ``universe`` (column ``key``); None if too large.

    Null keys are ignored; repeated keys count once; an empty list gives no levels.
    """
    marked = universe.where("key is not null").select("key", F.lit(0).alias("hit")).unionByName(listed.where("key is not null").select("key", F.lit(1).alias("hit")))
    marked = staged(marked.groupBy("key").agg(F.max("hit").alias("hit")), "url-universe")
    sizes = dict(marked.groupBy("hit").count().collect())
    n_in, n_out = sizes.get(1, 0), sizes.get(0, 0)
    sides = [marked.where("hit = 1").select("key"), marked.where("hit = 0").select("key")]
    levels: list[Level] = []
    held, n = 0, n_in  # the side that the next level encodes
    while n:
        rate = min(0.5, max(2.0**-30, math.sqrt(0.5) * n_in / max(1, n_out))) if not levels else 0.5
        if sum(level.bits for level in levels) + 2 * n * math.log2(1 / rate) + 64 > max_bits:
            return None
        number = len(levels)
        levels.append(_build(sides[held], number, n, rate))
        other = 1 - held
        sides[other] = sides[other].where(_passes(F.col("key"), number, levels[-1]))
        held, n = other, sides[other].count()
    return levels


def in_cascade(key: Column, levels: list[Level]) -> Column:
    """Whether a key of the universe is listed."""
    found = F.lit(len(levels) % 2 == 1)
    for number in range(len(levels) - 1, -1, -1):
        found = F.when(_passes(key, number, levels[number]), found).otherwise(F.lit(number % 2 == 1))
    return found


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty if it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    rest = F.when(rest.isNotNull(), F.substr(url, F.length(rest) + 4))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def url_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """All keys of a URL: host suffixes times path prefixes of the given lengths."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(parts, lambda x, i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def judge_urls(pages: DataFrame, rules: dict[str, str], id_column: str = "page_id", url_column: str = "url", max_bits: int = MAX_BITS) -> DataFrame:
    """``id_column, host, path, rule, verdict`` for every row.

    ``rules`` maps a rule (host, ``/`` and the rest of the path prefix) to ``allow`` or
    ``block``.  The longest fitting rule wins (of equally long ones that with the longer host).
    A URL that no rule fits is not listed and so allowed.
    """
    spark = pages.sparkSession
    lengths = sorted({len(rule) - rule.index("/") for rule in rules}) or [0]
    host, path = url_parts(F.col("url"))
    parsed = pages.select(F.col(id_column).alias("id"), F.col(url_column).cast("string").alias("url"))
    parsed = parsed.select("id", host.alias("host"), path.alias("path"))
    keyed = parsed.withColumn("keys", url_keys(F.col("host"), F.col("path"), lengths))
    universe = keyed.select(F.explode("keys").alias("key"))
    verdicts = ("block", "allow")
    lists = {v: [r for r, kind in rules.items() if kind == v] for v in verdicts}
    universe = staged(universe.distinct(), "url-keys")
    levels = {v: cascade(universe, spark.createDataFrame([(r,) for r in lists[v]], "key string"), max_bits) for v in verdicts}
    if any(found is None for found in levels.values()):
        return _judge_by_join(keyed, rules, id_column)

    def fits(key: Column) -> Column:
        verdict = F.lit(None).cast("string")
        for v in verdicts:
            verdict = F.when(in_cascade(key, levels[v]), F.lit(v)).otherwise(verdict)
        return F.when(verdict.isNotNull(), F.struct(F.length(key).alias("size"), F.instr(key, "/").alias("host_size"), key.alias("rule"), verdict.alias("verdict")))

    best = F.array_max(F.transform("keys", fits))
    judged = keyed.withColumn("best", best)
    return judged.select(F.col("id").alias(id_column), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


def _judge_by_join(keyed: DataFrame, rules: dict[str, str], id_column: str) -> DataFrame:
    """The same result for lists that are too long for literals: keys are joined with the list once each."""
    listed = keyed.sparkSession.createDataFrame(list(rules.items()), "key string, verdict string")
    keys = keyed.select(F.explode("keys").alias("key")).distinct().join(listed, "key")
    hits = keyed.select("host", "path", F.explode("keys").alias("key")).distinct().join(keys, "key")
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("key").alias("size"), F.instr("key", "/").alias("host_size"), F.col("key").alias("rule"), "verdict")).alias("best"))
    judged = keyed.join(best, ["host", "path"], "left")
    return judged.select(F.col("id").alias(id_column), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))
