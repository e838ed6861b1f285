"""A session with the settings the engine relies on: ANSI arithmetic, UTC, adaptive execution."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def session(master: str | None = None, partitions: int | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.config(map=SETTINGS | more)
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_tables(spark: SparkSession, sf_dir: str, text: str) -> SparkSession:
    """Register views of the tables that a query's text names."""
    for name in TABLES:
        if name in text:
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark
