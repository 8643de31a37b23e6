"""Registered queries: each is a plan over the tables of one directory, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan under ``name``; ``sql`` is DuckDB SQL for the same result."""

    def add(run: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return add


def load() -> None:
    """Import the modules that register plans."""
    from treeline.plans import details, objects, snapshots, storage  # noqa: F401


load()
