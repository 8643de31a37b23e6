"""Snapshot diffs, three-way classification and what follows from them.

Snapshots have ``path`` and any of ``kind, hash, size, mode, mtime_secs, target``; diffs are
full outer equi-joins on the path, with null-safe comparison of optional columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions.paths import ancestors, child_of_scope


def _side(snapshot: DataFrame, prefix: str) -> DataFrame:
    return snapshot.select("path", F.lit(True).alias(f"{prefix}_here"), *[F.col(c).alias(f"{prefix}_{c}") for c in snapshot.columns if c != "path"])


def diff(base: DataFrame, target: DataFrame, with_mode: bool = True) -> DataFrame:
    """``path, change (A, M, D), base_*, target_*`` of all paths that differ.

    Files differ by hash or, unless switched off, mode; symlinks by target. A kind that turns
    into another is one M; what a directory replaced is not reported as deleted.
    """
    joined = _side(base, "base").join(_side(target, "target"), "path", "full_outer")
    compared = [c for c in ("kind", "hash", "target", *(["mode"] if with_mode else [])) if c in base.columns and c in target.columns]
    same = F.lit(True)
    for c in compared:
        same = same & F.col(f"base_{c}").eqNullSafe(F.col(f"target_{c}"))
    change = F.when(F.col("base_here").isNull(), "A").when(F.col("target_here").isNull(), "D").when(~same, "M")
    return joined.withColumn("change", change).where("change is not null").drop("base_here", "target_here")


def label(change: Column) -> Column:
    return F.when(change == "A", "added").when(change == "M", "modified").when(change == "D", "deleted")


def deletions(base: DataFrame, target: DataFrame) -> DataFrame:
    return base.join(target.select("path"), "path", "left_anti")


def three_way(base: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """``path, local_change, remote_change, outcome`` of all paths that either side changed.

    ``clean``: only the remote changed, or both came to the same content (kind, hash and symlink target, modes
    aside; equal symlinks and empty directories have no hash); ``kept``: only the local side changed; else ``conflict``.
    """
    content = [c for c in ("kind", "hash", "target") if all(c in side.columns for side in (base, local, remote))]
    ours = diff(base, local).select("path", F.col("change").alias("local_change"), *[F.col(f"target_{c}").alias(f"local_{c}") for c in content])
    theirs = diff(base, remote).select("path", F.col("change").alias("remote_change"), *[F.col(f"target_{c}").alias(f"remote_{c}") for c in content])
    both = ours.join(theirs, "path", "full_outer")
    equal = F.lit(True)
    for c in content:
        equal = equal & F.col(f"local_{c}").eqNullSafe(F.col(f"remote_{c}"))
    deleted = (F.col("local_change") == "D").cast("int") + (F.col("remote_change") == "D").cast("int")
    same = (deleted == 2) | ((deleted == 0) & equal)
    outcome = F.when(F.col("local_change").isNull(), "clean").when(F.col("remote_change").isNull(), "kept").when(same, "clean").otherwise("conflict")
    return both.select("path", "local_change", "remote_change", outcome.alias("outcome"))


def preserved(local_diff: DataFrame, remote_diff: DataFrame) -> DataFrame:
    """Local changes that the remote left alone."""
    return local_diff.join(remote_diff.select("path"), "path", "left_anti")


def apply_changes(base: DataFrame, changes: DataFrame) -> DataFrame:
    """The snapshot after a diff against ``base``: untouched rows and the new ones."""
    columns = [c for c in base.columns if c != "path"]
    new = changes.where("change <> 'D'").select("path", *[F.col(f"target_{c}").alias(c) for c in columns])
    return base.join(changes.select("path"), "path", "left_anti").select("path", *columns).unionByName(new)


def conflict_rows(base: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """Each conflict with the three sides' hash, mode and time; an absent side is null."""
    conflicts = three_way(base, local, remote).where("outcome = 'conflict'")
    for name, side in (("base", base), ("local", local), ("remote", remote)):
        conflicts = conflicts.join(side.select("path", *[F.col(c).alias(f"{name}_{c}") for c in ("hash", "mode", "mtime_secs")]), "path", "left")
    return conflicts.drop("outcome")


def accept(conflicts: DataFrame, side: str) -> DataFrame:
    """``path, action, hash, mode``: takes one side of each conflict; an absent side deletes."""
    action = F.when(F.col(f"{side}_hash").isNull(), "delete").otherwise("write")
    return conflicts.select("path", action.alias("action"), F.col(f"{side}_hash").alias("hash"), F.col(f"{side}_mode").alias("mode"))


def collapse_added_trees(added: DataFrame, base: DataFrame, threshold: int) -> DataFrame:
    """Added files as directory stubs where a directory new to the base holds ``threshold`` bytes or more.

    Returns ``path, size, blob_count, is_stub`` with only the top-most such directory; no theta join:
    each file meets its own ancestors.
    """
    inside = added.select("path", "size", F.explode(ancestors(F.col("path"), with_root=False)).alias("dir"))
    old = base.select(F.explode(ancestors(F.col("path"), with_root=False)).alias("dir")).distinct()
    large = inside.groupBy("dir").agg(F.sum("size").alias("dir_size"), F.count("*").alias("blob_count")).where(F.col("dir_size") >= threshold).join(old, "dir", "left_anti")
    nested = large.select("dir", F.explode(ancestors(F.col("dir"), with_root=False)).alias("above")).join(large.select(F.col("dir").alias("above")), "above", "left_semi").select("dir")
    top = large.join(nested.distinct(), "dir", "left_anti")
    covered = inside.join(top.select("dir"), "dir", "left_semi").select("path").distinct()
    files = added.join(covered, "path", "left_anti").select("path", "size", F.lit(1).cast("long").alias("blob_count"), F.lit(False).alias("is_stub"))
    stubs = top.select(F.col("dir").alias("path"), F.col("dir_size").alias("size"), "blob_count", F.lit(True).alias("is_stub"))
    return files.unionByName(stubs) if threshold > 0 else added.select("path", "size", F.lit(1).cast("long").alias("blob_count"), F.lit(False).alias("is_stub"))


def directory_status(changes: DataFrame) -> DataFrame:
    """``path, status``: M for every directory (root: empty path) with a change below it."""
    return changes.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct().withColumn("status", F.lit("M"))


def marked_around(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """``rows`` with ``at_or_under`` a marked path and ``above`` one, by equi-joins on ancestors."""
    marks = marks.select("path").distinct()
    chain = rows.select("path", F.explode(F.concat(ancestors(F.col("path"), with_root=False), F.array("path"))).alias("at"))
    under = chain.join(marks.withColumnRenamed("path", "at"), "at", "left_semi").select("path").distinct().withColumn("at_or_under", F.lit(True))
    over = marks.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct().withColumn("above", F.lit(True))
    joined = rows.join(under, "path", "left").join(over, "path", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("at_or_under", "above")})


def unknown_status(rows: DataFrame, unreadable: DataFrame) -> DataFrame:
    """Rows under an unreadable path are unknown (``?``); so are its ancestors without a status."""
    marked = marked_around(rows, unreadable)
    status = F.when(F.col("at_or_under") | (F.col("above") & F.col("status").isNull()), "?").otherwise(F.col("status"))
    return marked.withColumn("status", status).drop("at_or_under", "above")


def ignored_rows(ignored: DataFrame, base: DataFrame) -> DataFrame:
    """Ignored paths: ``i`` and deleted if the base holds them, else ``I``."""
    known = base.select("path", F.lit(True).alias("known"))
    joined = ignored.select("path").join(known, "path", "left")
    return joined.select("path", F.when(F.col("known"), "i").otherwise("I").alias("z"), F.when(F.col("known"), "D").alias("status"))


def added_not_listed(added: DataFrame, listing: DataFrame, scope: str) -> DataFrame:
    """Added paths missing from a listing of the scope's children, rolled up to those children."""
    child = added.select(child_of_scope(F.col("path"), scope).alias("child"), "path").where("child is not null")
    rolled = child.groupBy("child").agg(F.max(F.when(F.col("child") == F.col("path"), "A").otherwise("M")).alias("status"), F.count("*").alias("n_added"))
    return rolled.join(listing.select(F.col("path").alias("child")), "child", "left_anti").withColumnRenamed("child", "path")


def overlay(preferred: DataFrame, fallback: DataFrame) -> DataFrame:
    """Rows of ``preferred``, and those of ``fallback`` at other paths."""
    return preferred.unionByName(fallback.join(preferred.select("path"), "path", "left_anti"))


def splice(snapshot: DataFrame, path: str, rows: DataFrame) -> DataFrame:
    """Replaces all at or under ``path`` by ``rows``; an empty ``rows`` removes it."""
    at = (F.col("path") == path) | F.col("path").startswith(path + "/")
    return snapshot.where(~at).unionByName(rows)


def restore_plan(base: DataFrame, working: DataFrame) -> DataFrame:
    """``path, action``: restore what is absent or differs in kind, content, symlink target or mode, delete what the base lacks, else skip."""
    joined = _side(base, "base").join(_side(working, "work"), "path", "full_outer")
    same = F.lit(True)
    for c in ("kind", "hash", "target", "mode"):
        if c in base.columns and c in working.columns:
            same = same & F.col(f"base_{c}").eqNullSafe(F.col(f"work_{c}"))
    action = F.when(F.col("base_here").isNull(), "delete").when(F.col("work_here").isNull() | ~same, "restore").otherwise("skip")
    return joined.select("path", action.alias("action"))


def reconcile_stubs(stubs: DataFrame, base: DataFrame) -> DataFrame:
    """``path, stub_kind, base_kind, action`` for every stub against the entry at its path."""
    known = base.select("path", F.col("kind").alias("base_kind"))
    joined = stubs.select("path", "stub_kind").join(known, "path", "left")
    pair = F.concat_ws("/", F.coalesce("base_kind", F.lit("absent")), F.col("stub_kind"))
    action = (
        F.when(pair.isin("blob/file", "tree/dir"), "update")
        .when(pair == "blob/dir", "to_file_stub")
        .when(pair == "tree/file", "to_dir_stub")
        .when(F.col("base_kind") == "symlink", "create_symlink")
        .otherwise("remove")
    )
    return joined.withColumn("action", action)


def fetch_plan(changes: DataFrame, cached: DataFrame, threshold: int) -> DataFrame:
    """Distinct hashes of added or modified files that are below the stub threshold (0: none) and not cached."""
    small = F.lit(True) if threshold <= 0 else F.col("target_size") < threshold
    wanted = changes.where("change <> 'D'").where(small).select(F.col("target_hash").alias("hash"), F.col("target_size").alias("size")).dropDuplicates(["hash"])
    return wanted.join(cached.select("hash"), "hash", "left_anti")


def git_context(paths: DataFrame) -> DataFrame:
    """Paths at or below a directory that holds ``.git``."""
    homes = paths.select(F.explode(F.concat(ancestors(F.col("path"), with_root=False), F.array("path"))).alias("p")).where("p = '.git' or p like '%/.git'").select(F.regexp_extract("p", "^(.*?)/?[.]git$", 1).alias("home")).distinct()
    chain = paths.select("path", F.explode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("home"))
    return chain.join(homes, "home", "left_semi").select("path").distinct()


def without_covered(paths: DataFrame) -> DataFrame:
    """Distinct paths, without those that another path covers."""
    paths = paths.select("path").distinct()
    below = paths.select("path", F.explode(ancestors(F.col("path"))).alias("above")).join(paths.select(F.col("path").alias("above")), "above", "left_semi")
    return paths.join(below.select("path").distinct(), "path", "left_anti")


def emptied_directories(deleted: DataFrame, remaining: DataFrame) -> DataFrame:
    """Directories of deleted paths that hold nothing any more, deepest first."""
    over = lambda rows: rows.select(F.explode(ancestors(F.col("path"), with_root=False)).alias("path")).distinct()
    return over(deleted).join(over(remaining), "path", "left_anti").orderBy(F.size(F.split("path", "/")).desc(), "path")


def listing(snapshot: DataFrame, changes: DataFrame, ignored: F.Column) -> DataFrame:
    """Listing rows of files that are not ignored: status char (blank: unchanged), hash shortened to eight digits, size, path."""
    status = changes.where("change <> 'D'").select("path", F.col("change").alias("status"))
    shown = snapshot.where(~ignored).join(status, "path", "left")
    return shown.select(F.coalesce("status", F.lit(" ")).alias("status"), F.substring("hash", 1, 8).alias("hash"), "size", "path").orderBy("path")
