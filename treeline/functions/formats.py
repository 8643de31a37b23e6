"""Text forms of sizes, durations and times, and their parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KIB, MIB, GIB = 1 << 10, 1 << 20, 1 << 30


def _one_decimal(size: Column, unit: int) -> Column:
    return F.format_string("%.1f", F.bround(size / F.lit(float(unit)), 1))  # ties to even


def format_size(size: Column, compact: bool = False) -> Column:
    gap = "" if compact else " "
    shown = F.concat(size.cast("string"), F.lit(f"{gap}B"))
    for unit, name in ((KIB, "KiB"), (MIB, "MiB"), (GIB, "GiB")):
        shown = F.when(size >= unit, F.concat(_one_decimal(size, unit), F.lit(gap + name))).otherwise(shown)
    return shown


def format_size_log(size: Column) -> Column:
    small = F.concat(size.cast("string"), F.lit(" B"))
    return F.when(size >= MIB, F.concat(_one_decimal(size, MIB), F.lit(" M"))).when(size >= KIB, F.concat(_one_decimal(size, KIB), F.lit(" K"))).otherwise(small)


def format_count(n: Column) -> Column:
    return F.format_number(n, 0)


def format_duration(seconds: Column) -> Column:
    """``1.250s``, ``12ms`` or ``7us``."""
    return (
        F.when(seconds >= 1, F.concat(F.format_string("%.3f", F.bround(seconds, 3)), F.lit("s")))
        .when(seconds >= 0.001, F.concat(F.floor(seconds * 1000 + 0.5).cast("string"), F.lit("ms")))
        .otherwise(F.concat(F.floor(seconds * 1000000 + 0.5).cast("string"), F.lit("us")))
    )


def parse_size(text: Column) -> Column:
    """Bytes of ``1024``, ``100K``, ``1m`` or ``2G``; null for anything else or beyond 2**63 - 1."""
    digits = F.regexp_extract(text, r"^([0-9]+)[KkMmGg]?\z", 1)
    unit = F.upper(F.regexp_extract(text, r"^[0-9]+([KkMmGg])\z", 1))
    factor = F.when(unit == "K", KIB).when(unit == "M", MIB).when(unit == "G", GIB).otherwise(1).cast("decimal(19,0)")
    value = F.when((digits != "") & (F.length(F.regexp_replace(digits, "^0+", "")) <= 19), digits.cast("decimal(19,0)")) * factor
    return F.when(value <= F.lit(str(2**63 - 1)).cast("decimal(19,0)"), value.cast("bigint"))


def timestamp_of_stem(stem: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` of a log file stem ``YYYYMMDD-HHMMSS-command``, else the stem."""
    shown = F.regexp_replace(stem, "^(.{4})(.{2})(.{2})-(.{2})(.{2})(.{2}).*$", "$1-$2-$3 $4:$5:$6")
    return F.when(stem.rlike("^.{8}-.{6}"), shown).otherwise(stem)


def format_time(ts: Column) -> Column:
    """``MM-DD HH:MM:SS`` of an ISO-8601 time."""
    plain = F.regexp_replace(F.replace(ts, F.lit("T"), F.lit(" ")), "Z+$", "")
    shaped = (F.length(ts) >= 19) & (F.substring(ts, 5, 1) == "-") & (F.substring(ts, 11, 1) == "T")
    return F.when(shaped, F.concat(F.substring(ts, 6, 5), F.lit(" "), F.substring(ts, 12, 8))).otherwise(plain)


def format_mtime(seconds: Column, now: int) -> Column:
    """``now``, ``5m``, ``MM-DD HH:MM`` (today to 14 days ago) or ``YYYY-MM-DD``; days in the session's time zone."""
    at, current = F.timestamp_seconds(seconds), F.timestamp_seconds(F.lit(now))
    days = F.datediff(current, at)
    age = F.lit(now) - seconds
    return (
        F.when((age >= 0) & (age < 60), "now")
        .when((age >= 0) & (age < 3600), F.concat(F.floor(age / 60).cast("string"), F.lit("m")))
        .when((days >= 0) & (days <= 14), F.date_format(at, "MM-dd HH:mm"))
        .otherwise(F.date_format(at, "yyyy-MM-dd"))
    )


def epoch_parts(seconds: Column) -> tuple[Column, Column]:
    """(whole seconds rounded down, nanoseconds) of fractional epoch seconds at microsecond precision."""
    micros = F.round(seconds * 1000000).cast("bigint")
    return F.floor(micros / 1000000).cast("bigint"), (F.pmod(micros, F.lit(1000000)) * 1000).cast("int")


def truncate(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def history_timestamp(line: Column) -> Column:
    """Epoch of a shell-history line ``: <epoch>:<duration>;...``, else null."""
    found = F.regexp_extract(line, "^: ([0-9]+):([0-9]+);", 1)
    return F.when(found != "", found.try_cast("bigint"))


def abbreviate(hex_hash: Column, n: int = 8) -> Column:
    return F.substring(hex_hash, 1, n)
