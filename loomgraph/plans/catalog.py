"""Registry of named queries, each with the SQL it must agree with where SQL can say it."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import Tables, with_views

CATALOG: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}


def query(views: str = "", sql: str | None = None):
    """Register a builder; ``views`` names the shared SQL views its oracle reads."""
    def wrap(fn: Callable[[Tables], DataFrame]):
        CATALOG[fn.__name__] = (fn, None if sql is None else with_views(views, sql))
        return fn
    return wrap


def load() -> None:
    from . import (conv_queries, edge_queries, event_queries, factor_queries,  # noqa: F401
                   format_queries, matrix_queries, model_queries, panel_queries, partition_queries, pool_queries,
                   reduce_queries, sample_queries, spatial_queries, text_queries,
                   transform_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return {name: (lambda spark, path, fn=fn: fn(Tables(spark, path)))
            for name, (fn, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    load()
    return {name: sql for name, (_, sql) in CATALOG.items() if sql is not None}
