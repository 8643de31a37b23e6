"""Three-way line merge of append-mostly files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeline.functions.formats import history_timestamp

_STAMP = re.compile(rb": ([0-9]+):[0-9]+;")


def lines_of(content: bytes | None) -> list[bytes]:
    """Lines; a final newline ends the last one, and nothing has no lines."""
    if not content:
        return []
    found = content.split(b"\n")
    return found[:-1] if found[-1] == b"" else found


def timestamp(line: bytes) -> int | None:
    found = _STAMP.match(line)
    value = int(found[1]) if found else None
    return value if value is not None and value < 1 << 63 else None


def matching(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, by Myers' greedy search from the start.

    Common ends are taken off first; the frontier of each edit distance is kept for the way back.
    """
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    x_end, y_end = len(a) - low - high, len(b) - low - high
    reach, trail = {1: 0}, []
    for d in range(x_end + y_end + 1):
        trail.append(dict(reach))
        for k in range(-d, d + 1, 2):
            down = k == -d or (k != d and reach[k - 1] < reach[k + 1])
            x = reach[k + 1] if down else reach[k - 1] + 1
            while x < x_end and x - k < y_end and a[low + x] == b[low + x - k]:
                x += 1
            reach[k] = x
            if x >= x_end and x - k >= y_end:
                break
        else:
            continue
        break
    pairs, x, y = [], x_end, y_end
    for d in range(len(trail) - 1, -1, -1):
        from_x = from_y = begin = 0
        if d:
            reach, k = trail[d], x - y
            down = k == -d or (k != d and reach[k - 1] < reach[k + 1])
            from_k = k + 1 if down else k - 1
            from_x, from_y = reach[from_k], reach[from_k] - from_k
            begin = from_x if down else from_x + 1
        while x > begin:  # equal lines after the edit
            x, y = x - 1, y - 1
            pairs.append((low + x, low + y))
        x, y = from_x, from_y
    pairs.reverse()
    tail = [(len(a) - high + i, len(b) - high + i) for i in range(high)]
    return [(i, i) for i in range(low)] + pairs + tail


def changes(base: list[bytes], other: list[bytes]) -> tuple[set[int], list[tuple[int, int, list[bytes]]]]:
    """(kept base lines, changes as (first, end, new lines) over base ranges)."""
    pairs = [*matching(base, other), (len(base), len(other))]
    found, i, k = [], 0, 0
    for x, y in pairs:
        if x > i or y > k:
            found.append((i, x, other[k:y]))
        i, k = x + 1, y + 1
    return {x for x, _ in pairs[:-1]}, found


def merge(base: bytes | None, local: bytes | None, remote: bytes | None) -> bytes | None:
    """The merged content, or None on a conflict: both sides replaced overlapping base lines.

    A base line stays if either side kept it.  If any line has a time stamp, lines are sorted by it (those
    without one first, equal ones in order); else base lines come first, then local and remote new lines.
    """
    sides = [lines_of(x) for x in (base, local, remote)]
    (kept_l, new_l), (kept_r, new_r) = changes(sides[0], sides[1]), changes(sides[0], sides[2])
    for a, b, lines in new_l:
        if lines and any(other and max(a, c) < min(b, d) for c, d, other in new_r):
            return None
    merged = [line for i, line in enumerate(sides[0]) if i in kept_l or i in kept_r]
    merged += [line for side in (new_l, new_r) for change in side for line in change[2]]
    if any(timestamp(line) is not None for side in sides for line in side):
        merged.sort(key=lambda line: -(1 << 63) if timestamp(line) is None else timestamp(line))
    return b"".join(line + b"\n" for line in merged)


def merged_files(files: DataFrame) -> DataFrame:
    """``path, outcome (clean or conflict), content`` of ``files`` (path, base, local, remote; null: absent)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            done = [merge(*(bytes(x) if x is not None else None for x in r)) for r in zip(rows["base"], rows["local"], rows["remote"], strict=True)]
            yield pd.DataFrame({"path": rows["path"], "outcome": ["conflict" if d is None else "clean" for d in done], "content": done})

    return files.select("path", "base", "local", "remote").mapInPandas(run, "path string, outcome string, content binary")


def merged_appends(lines: DataFrame) -> DataFrame:
    """The fast path where both sides only append: ``path, seq, line`` from ``path, side (0 base, 1 local, 2 remote), no, line``.

    No Python and no file in one row; order is by time stamp (none first), then side and place.
    """
    stamp = F.coalesce(history_timestamp(F.col("line")), F.lit(-(2**63)))
    place = Window.partitionBy("path").orderBy(stamp, "side", "no")
    return lines.select("path", F.row_number().over(place).cast("long").alias("seq"), "line")


def eligible(conflicts: DataFrame, is_line_merge: F.Column) -> DataFrame:
    """Conflicts that a line merge may resolve: both sides changed the content of a file that the rules name."""
    both = F.col("local_change").isin("A", "M") & F.col("remote_change").isin("A", "M")
    return conflicts.where(both & is_line_merge)


def releasable(merged: DataFrame, conflicts: DataFrame) -> DataFrame:
    """All or nothing: merged files only if no conflict is left."""
    left = conflicts.join(merged.where("outcome = 'clean'").select("path"), "path", "left_anti")
    return merged.where("outcome = 'clean'") if left.isEmpty() else merged.limit(0)
