"""Path expressions: ancestors, scopes, normalisation and reserved names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

APP = "snap"  # the part of reserved names that an application chooses


def ancestors(path: Column, with_root: bool = True) -> Column:
    """All proper ancestor directories, the root as an empty string."""
    parts = F.split(path, "/")
    deep = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    found = F.when(F.size(parts) > 1, deep).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.lit("")), found) if with_root else found


def parent(path: Column) -> Column:
    """The parent directory, empty for a top-level name."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*\z", 1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def join_path(directory: Column, name: Column) -> Column:
    return F.when(directory == "", name).otherwise(F.concat_ws("/", directory, name))


def depth(path: Column) -> Column:
    return F.when(path == "", F.lit(0)).otherwise(F.size(F.split(path, "/")))


def in_scope(path: Column, scopes: list[str]) -> Column:
    """Equal to or under one of the scopes; an empty scope list means everything."""
    if not scopes or "" in scopes:
        return F.lit(True)
    found = F.lit(False)
    for p in scopes:
        found = found | (path == p) | path.startswith(p + "/")
    return found


def in_scope_range(path: Column, scope: str) -> Column:
    """:func:`in_scope` of one scope with a range that data sorted by path can be pruned with."""
    return (path >= scope) & (path < scope + "0") & in_scope(path, [scope])


def should_descend(directory: Column, scopes: list[str]) -> Column:
    """In scope, or an ancestor of a scope."""
    found = in_scope(directory, scopes)
    for p in scopes:
        found = found | F.lit(p).startswith(F.concat(directory, F.lit("/"))) | (directory == "")
    return found


def is_direct_child(path: Column, directory: str) -> Column:
    if not directory:
        return (path != "") & ~path.contains("/")
    rest = F.substr(path, F.lit(len(directory) + 2))
    return path.startswith(directory + "/") & (rest != "") & ~rest.contains("/")


def child_of_scope(path: Column, scope: str) -> Column:
    """The direct child of ``scope`` that holds ``path``, or the path itself; null outside."""
    if not scope:
        return F.substring_index(path, "/", 1)
    rest = F.substr(path, F.lit(len(scope) + 2))
    return F.when(path.startswith(scope + "/"), F.concat(F.lit(scope + "/"), F.substring_index(rest, "/", 1)))


def normalise(path: Column, cwd: str = "") -> Column:
    """A path against ``cwd`` within the root, ``.`` and ``..`` folded; null if it leaves the root."""
    full = F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", F.lit(cwd), path))
    parts = F.filter(F.split(full, "/"), lambda p: (p != "") & (p != "."))
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(True).alias("inside"))

    def fold(state, p):
        at = state["at"]
        up = F.when(F.size(at) > 0, F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(at)
        return F.struct(F.when(p == "..", up).otherwise(F.concat(at, F.array(p))).alias("at"), (state["inside"] & ((p != "..") | (F.size(at) > 0))).alias("inside"))

    return F.aggregate(parts, start, fold, lambda s: F.when(s["inside"], F.array_join(s["at"], "/")))


def reserved_kind(path: Column, app: str = APP) -> Column:
    """helper, meta, stub, filter, unknown (another reserved name) or null."""
    name = base_name(path)
    mark = f".{app}-"
    return (
        F.when(name.endswith(f"{mark}base") | name.endswith(f"{mark}local") | name.endswith(f"{mark}remote"), "helper")
        .when(name.endswith(f"{mark}meta"), "meta")
        .when(name.endswith(f"{mark}stub"), "stub")
        .when(name == f".{app}filter", "filter")
        .when(name.contains(mark), "unknown")
    )


def conflict_base(path: Column, app: str = APP) -> Column:
    """The path that a conflict helper or its metadata belongs to, else null."""
    return F.when(reserved_kind(path, app).isin("helper", "meta"), F.regexp_replace(path, rf"\.{app}-(base|local|remote|meta)$", ""))


def is_system_path(path: Column, app: str = APP) -> Column:
    return F.substring_index(path, "/", 1) == f".{app}"


def stub_logical(path: Column, app: str = APP) -> Column:
    """The path that a stub stands for: its name without the suffix, or its directory."""
    suffix = f".{app}-stub"
    return F.when(base_name(path) == suffix, parent(path)).when(path.endswith(suffix), F.regexp_replace(path, rf"\.{app}-stub$", ""))


def split_target(target: Column) -> tuple[Column, Column]:
    """(reference, path) of ``ref:path`` or ``ref/path``; the path is null if absent."""
    ref = F.regexp_extract(target, "^([^:/]*)", 1)
    rest = F.regexp_extract(target, r"(?s)^[^:/]*[:/](.*)\z", 1)
    return ref, F.when(target.rlike("^[^:/]*[:/]"), rest)
