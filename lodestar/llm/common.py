"""Shared plumbing: the cluster's shared folder, materialised tables, order buckets and word splitting."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Limits of one Arrow batch sent to Python: rows, and bytes where texts are long.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of this session's own only where that is unset (tests)."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="lodestar-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/lodestar/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to a new Parquet table in the shared folder and read it back: lineage ends there, and a lost
    executor costs no more than the tasks it ran."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestar_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the table behind a materialized DataFrame that no later plan reads."""
    remove(df.sparkSession, df._lodestar_path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def sweep(spark: SparkSession) -> None:
    """Let the driver forget plans that are done, so that Spark deletes their shuffle files now and not at some later time."""
    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Bound what one batch holds. Plans read these settings when they run, so they stay set in the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def lean(f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """f for mapInPandas, giving its memory back to the system when a task ends: workers live on, and several stand in
    one executor."""

    @functools.wraps(f)
    def g(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from f(batches)
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return g


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have in any case."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


class WordHashes(dict):
    """XXH64 of words. Long words are computed anew each time, so that a bounded number of entries bounds memory."""

    MOST, LONGEST = 100_000, 64

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[word] = h
        return h


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, whole text (null: empty) and the columns in more; any other column stays out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def order_bounds(df: DataFrame, column: str, buckets: int) -> list[int]:
    """Ascending values of an integer column that cut its rows into about equal ranges: at most buckets - 1 of them,
    however many rows there are. The last value is the maximum."""
    row = df.agg(
        F.percentile_approx(column, [i / buckets for i in range(1, buckets)] or [0.5], max(10_000, 20 * buckets)).alias("cuts"),
        F.max(column).alias("top"),
    ).first()
    return [] if row["top"] is None else sorted({*row["cuts"], row["top"]})


def bucket_of(value: Column, bounds: list[int]) -> Column:
    """How many bounds lie below value (null: 0), found in two short array passes of about the root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    whole, coarse = F.lit(bounds).cast("array<bigint>"), F.lit(bounds[::step]).cast("array<bigint>")
    below = lambda values: F.size(F.filter(values, lambda b: b < value))
    ahead = below(coarse)
    inside = below(F.slice(whole, (ahead - 1) * step + 1, F.lit(step)))
    return F.when(value.isNull() | (ahead == 0), 0).otherwise((ahead - 1) * step + inside).cast("int")


def order_buckets(spark: SparkSession) -> int:
    """Ranges an ordered operator deals its rows to: some for each shuffle partition, so that sizes even out."""
    return min(8 * shuffle_partitions(spark), 20_000)


def crc_mod(column: str, n: int) -> Column:
    return F.crc32(F.col(column).cast("string")) % n


def split_words(text: str) -> list[bytes]:
    """The runs of [^\\x20\\x09-\\x0D] in UTF-8; bytes.split() cuts at just these six bytes."""
    return text.encode().split()
