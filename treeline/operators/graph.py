"""Walks over content-addressed objects: reachability, flattening, uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.functions.paths import join_path
from treeline.sources.staging import cut


def reachable(roots: DataFrame, edges: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """``hash`` of all objects reachable from ``roots`` over ``edges`` (parent, child), each once.

    Objects in ``stop`` are neither returned nor walked into.  A round for each level, cut
    through the shared folder; the frontier holds unseen objects only.
    """
    frontier = roots.select("hash").distinct()
    if stop is not None:
        stop = stop.select("hash").distinct()
        frontier = frontier.join(stop, "hash", "left_anti")
    seen = frontier = cut(frontier)
    while True:
        step = edges.join(frontier, edges["parent"] == frontier["hash"], "left_semi").select(F.col("child").alias("hash")).distinct()
        step = step.join(seen, "hash", "left_anti")
        frontier = cut(step if stop is None else step.join(stop, "hash", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionByName(frontier))


def upload_plan(roots: DataFrame, edges: DataFrame, remote: DataFrame) -> DataFrame:
    """Objects to upload: reachable ones that the remote lacks; what the remote has is not walked into."""
    return reachable(roots, edges, stop=remote)


def flatten(root: str, entries: DataFrame, with_dirs: bool = False) -> DataFrame:
    """``path, kind, hash, size`` below a tree; ``entries`` has ``tree_hash, name, kind, hash, size``.

    A join for each level, from the root down.
    """
    spark = entries.sparkSession
    level = spark.createDataFrame([("", root)], "dir string, tree string")
    found = None
    while True:
        rows = level.join(entries, F.col("tree") == F.col("tree_hash")).select(join_path(F.col("dir"), F.col("name")).alias("path"), "kind", "hash", "size")
        rows = cut(rows)
        here = rows if with_dirs else rows.where("kind <> 'tree'")
        found = here if found is None else found.unionByName(here)
        level = rows.where("kind = 'tree'").select(F.col("path").alias("dir"), F.col("hash").alias("tree"))
        if level.isEmpty():
            return found


def navigate(paths: DataFrame, path: str) -> DataFrame:
    """The entry at a path of a snapshot flattened with directories."""
    return paths.where(F.col("path") == path)


def expand_or_stub(leaves: DataFrame, threshold: int, exact: list[str] | None = None) -> DataFrame:
    """``path, is_stub``: files of ``threshold`` bytes or more stay stubs (0: none), but for those named exactly."""
    stub = (F.lit(threshold) > 0) & (F.col("size") >= threshold) & ~F.col("path").isin(exact or [])
    return leaves.withColumn("is_stub", stub)
