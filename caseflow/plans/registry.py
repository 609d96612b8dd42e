"""Registered queries: a Spark function over the inputs and, where SQL can say it, the same result as SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from caseflow.plans.adapters import Inputs, with_adapters


@dataclass(frozen=True)
class Query:
    run: Callable[[Inputs], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, uses: list[str] | None = None, sql: str | None = None, extra: dict[str, str] | None = None):
    """Register a function of ``Inputs``; ``uses`` are the adapters its SQL starts from."""

    def add(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(fn, None if sql is None else with_adapters(uses or [], sql, extra))
        return fn

    return add


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, folder, q=q: q.run(Inputs(spark, folder))) for name, q in QUERIES.items()}


def reference_sql() -> dict[str, str]:
    return {name: q.sql for name, q in QUERIES.items() if q.sql is not None}
