"""Query registry.

A registered query is ``fn(spark, sf_dir) -> DataFrame`` plus, where SQL can
express it, the oracle text DuckDB runs on the same parquet tables.  Column
names and rounding agree between the two sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bindings_sql import with_bindings

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register ``fn`` under ``name``; ``uses`` names the SQL bindings the oracle reads."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = with_bindings(sql, uses)
        return fn
    return deco


def _load_all() -> None:
    # Importing the catalogue modules fills the registry.
    from . import (q_io, q_quality, q_sampling, q_metrics, q_rollups, q_history,  # noqa: F401
                   q_logs, q_registry, q_similarity, q_corpus, q_streaming, q_udf)


def all_queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def all_oracles() -> dict[str, str]:
    _load_all()
    return dict(_ORACLES)
