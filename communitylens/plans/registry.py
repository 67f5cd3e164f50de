"""Query registry: key -> Spark builder, key -> oracle SQL.

A query builder takes ``(spark, sf_dir)`` and returns a DataFrame.  Its
oracle (if the operator is SQL-expressible) is a DuckDB string over the raw
tables; canonical views are added by ``with_views``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from communitylens.plans.oracle_views import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}  # raw SQL; views are added by oracle_sql()


def query(key: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module so that its decorators run."""
    from communitylens.plans import (  # noqa: F401
        q_sources, q_filters, q_joins, q_stats, q_cooccur, q_windows, q_sets,
        q_scalar, q_edges, q_features, q_text, q_model, q_stream,
    )


def oracle_sql() -> dict[str, str]:
    """Oracle strings with the canonical views they use prepended."""
    load_all()
    return {k: with_views(v) for k, v in ORACLE.items()}
