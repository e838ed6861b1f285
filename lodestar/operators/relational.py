"""The relational operators as functions of DataFrames; Catalyst chooses how each runs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.plans.errors import UnsupportedFeature

JOINS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}


def seq_scan(source: DataFrame, columns: Sequence[str] | None = None, where: Column | str | None = None) -> DataFrame:
    """Rows for which the predicate is true; a column that the source lacks is null."""
    df = source.where(where) if where is not None else source
    if columns is None:
        return df
    have = {c.lower() for c in source.columns}
    return df.select([F.col(c) if c.lower() in have else F.lit(None).cast("string").alias(c) for c in columns])


def index_scan(source: DataFrame, key: Column | str, columns: Sequence[str] | None = None, where: Column | str | None = None) -> DataFrame:
    """Point or range look-up: the key predicate reaches the Parquet reader, whose row-group statistics skip data that
    bulk_load() has sorted."""
    df = source.where(key)
    return seq_scan(df, columns, where)


def bulk_load(df: DataFrame, path: str, *keys: str, files: int | None = None) -> None:
    """Write sorted by key, so that look-ups by it skip row groups."""
    ranged = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def values(spark: SparkSession, rows: Iterable[Sequence], names: Sequence[str] = ()) -> DataFrame:
    """Inline rows; columns without a name are col_0, col_1, ..."""
    rows = [tuple(r) for r in rows]
    width = len(rows[0]) if rows else len(names)
    return spark.createDataFrame(rows, [*names, *(f"col_{i}" for i in range(len(names), width))][:width])


def filter_rows(df: DataFrame, where: Column | str) -> DataFrame:
    return df.where(where)


def project(df: DataFrame, *items: Column | str) -> DataFrame:
    return df.select([F.expr(i) if isinstance(i, str) and not i.endswith("*") else i for i in items])


view_as = project


def join(left: DataFrame, right: DataFrame, on: Column | Sequence[str] | None = None, how: str = "inner", hint: str | None = None) -> DataFrame:
    """hint: hash, merge or broadcast; None leaves the choice to the optimiser and its run-time statistics."""
    if hint:
        right = right.hint({"hash": "shuffle_hash", "merge": "merge", "broadcast": "broadcast"}[hint])
    if how == "cross":
        return left.crossJoin(right)
    if how not in JOINS:
        raise UnsupportedFeature(f"join type {how}")
    return left.join(right, on, JOINS[how])


AGGREGATES = {
    "COUNT": F.count, "COUNT_DISTINCT": F.count_distinct, "SUM": lambda c: F.sum(F.col(c).cast("double") if isinstance(c, str) else c.cast("double")), "AVG": F.avg,
    "MIN": F.min, "MAX": F.max, "STDDEV": F.stddev_samp, "VARIANCE": F.var_samp, "GROUP_CONCAT": lambda c: F.concat_ws(",", F.array_sort(F.collect_list(c))),
    "ARRAY_AGG": F.collect_list, "STRING_AGG": lambda c: F.concat_ws(",", F.array_sort(F.collect_list(c))),
}


def aggregate(df: DataFrame, keys: Sequence[Column | str], items: Sequence[tuple[str, Column | str, str]], having: Column | str | None = None) -> DataFrame:
    """items: (aggregate, argument, output name); * counts rows. A global aggregate gives one row on no input."""
    made = []
    for name, argument, alias in items:
        if name.upper() not in AGGREGATES:
            raise UnsupportedFeature(f"aggregate {name}")
        made.append((F.count(F.lit(1)) if argument == "*" else AGGREGATES[name.upper()](argument)).alias(alias))
    out = df.groupBy(*keys).agg(*made)
    return out.where(having) if having is not None else out


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def sort(df: DataFrame, *keys: tuple[str, bool] | str) -> DataFrame:
    """Keys ascend with nulls first; (key, False) descends with nulls last."""
    return df.orderBy(*[F.col(k).asc_nulls_first() if isinstance(k, str) else F.col(k[0]).asc_nulls_first() if k[1] else F.col(k[0]).desc_nulls_last() for k in keys])


def limit(df: DataFrame, n: int | None = None, offset: int = 0) -> DataFrame:
    out = df.offset(offset) if offset else df
    return out if n is None else out.limit(n)


def unnest(df: DataFrame, column: str, name: str = "unnest") -> DataFrame:
    """A row for each element; none for a null or empty array; a scalar passes through."""
    kind = dict(df.dtypes)[column]
    return df.select("*", F.explode(column).alias(name) if kind.startswith("array") else F.col(column).alias(name))
