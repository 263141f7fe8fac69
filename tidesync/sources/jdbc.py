"""The operational (serving) store over JDBC: partitioned scans and batched appends.

A full staging scan is split into ``num_partitions`` key ranges read in parallel by the
executors; nothing passes through the driver. Key filters given to ``point_lookup`` are pushed
into the database's WHERE clause by Spark.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def key_bounds(spark: SparkSession, url: str, table: str, key: str, options: Mapping[str, str]) -> tuple[int, int]:
    """Min and max of the key, computed by the database (one tiny query)."""
    q = f"(SELECT MIN({key}) AS lo, MAX({key}) AS hi FROM {table}) b"
    row = spark.read.format("jdbc").options(url=url, dbtable=q, **options).load().first()
    return (int(row["lo"] or 0), int(row["hi"] or 0))


def read_partitioned(spark: SparkSession, url: str, table: str, key: str, num_partitions: int,
                     options: Mapping[str, str] | None = None,
                     bounds: tuple[int, int] | None = None, fetch_size: int = 10_000) -> DataFrame:
    """Full scan of ``table`` as ``num_partitions`` parallel key-range queries."""
    options = dict(options or {})
    lo, hi = bounds if bounds is not None else key_bounds(spark, url, table, key, options)
    return (spark.read.format("jdbc")
            .options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(lo),
                     upperBound=str(hi + 1), numPartitions=str(num_partitions),
                     fetchsize=str(fetch_size), **options)
            .load())


def incremental(df: DataFrame, stamp_col: str, after) -> DataFrame:
    """Rows changed after a high-water mark (deletes are not visible this way)."""
    return df.where(F.col(stamp_col) > F.lit(after))


def append(df: DataFrame, url: str, table: str, options: Mapping[str, str] | None = None,
           batch_size: int = 10_000, num_partitions: int | None = None) -> None:
    """Append rows in batches; one transaction per partition, ``num_partitions`` connections."""
    out = df.coalesce(num_partitions) if num_partitions else df
    (out.write.format("jdbc").mode("append")
     .options(url=url, dbtable=table, batchsize=str(batch_size), **dict(options or {}))
     .save())
