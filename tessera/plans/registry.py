"""Registry of named queries: a Spark callable and, where SQL can say the
same thing, an independent DuckDB oracle over the same driver tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    fn: QueryFn
    oracle: str | None
    doc: str


REGISTRY: dict[str, Query] = {}


def register(name: str, oracle: str | None = None):
    """Decorator: add ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def wrap(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, oracle, (fn.__doc__ or "").strip())
        return fn

    return wrap


def load_all() -> dict[str, Query]:
    """Import every query module so their ``register`` calls run."""
    from tessera.plans import (  # noqa: F401
        catalog_queries,
        content_queries,
        files_queries,
        geo_queries,
        merge_queries,
        quality_queries,
        request_queries,
        sink_queries,
        stream_queries,
        text_queries,
        usage_queries,
    )

    return REGISTRY
