"""The registered queries: name -> Spark callable, check SQL, operators covered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}


def query(*covers: str, sql: str | None = None, name: str | None = None):
    """Register a (spark, folder) -> DataFrame function under its own name."""

    def add(fn):
        label = name or fn.__name__
        if label in QUERIES:
            raise ValueError(f"duplicate query {label}")
        QUERIES[label] = fn
        COVERS[label] = covers
        if sql is not None:
            ORACLE[label] = sql
        return fn

    return add
