"""Registered queries: one Spark job per operator key, each with its DuckDB oracle.

Every callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole input tables. ``ORACLE[key]`` is the equivalent SQL over the same tables
(views named after the parquet files); keys without SQL get a rows-only check.
"""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_MODULES = ["text", "retrieval", "lm", "metrics", "bytes", "trainset", "codec", "media", "streams", "io",
            "index", "sqltables"]


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query key {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from tessera.session import apply_defaults
            apply_defaults(spark)          # checkpoint folder, package on the workers
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    for m in _MODULES:
        importlib.import_module(f"tessera.catalog.{m}")
