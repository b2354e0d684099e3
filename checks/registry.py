"""Registry of checked queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks import fixtures, views

QUERIES: dict[str, Callable[[fixtures.Data], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query over ``fixtures.Data`` and its SQL; views named ``v_…`` are added."""

    def add(build):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build

    return add


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: (lambda spark, sf_dir, b=b: b(fixtures.data(spark, sf_dir))) for n, b in QUERIES.items()}


def oracle() -> dict[str, str]:
    return {n: views.sql(text) for n, text in ORACLE.items()}
