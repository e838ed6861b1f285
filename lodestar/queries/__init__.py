"""The engine's registered queries: SQL texts that both engines read alike, and DataFrame queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.plans import dialect
from lodestar.session import with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """A query in SQL, through the dialect front end; oracle is given where the second engine spells it otherwise."""
    QUERIES[name] = lambda spark, sf_dir: dialect.query(with_tables(spark, sf_dir, text), text)
    ORACLE_SQL[name] = oracle or text


def frame(oracle: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) under its own name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


from lodestar.queries import engine, relational, scalar  # noqa: E402, F401
