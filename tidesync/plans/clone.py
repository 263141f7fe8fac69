"""Snapshot clones of lake tables into an own schema, created only where absent."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidesync.plans.publish import create_schema


def snapshot_clone(spark: SparkSession, source: DataFrame, target: str) -> bool:
    """``CREATE TABLE IF NOT EXISTS target AS SELECT * FROM source``.

    An existing target is left untouched, even if stale. Returns True when it was created.
    The copy runs on the executors as one write job.
    """
    existed = spark.catalog.tableExists(target)
    view = f"__clone_src_{uuid.uuid4().hex[:10]}"
    source.createOrReplaceTempView(view)
    try:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {target} USING parquet AS SELECT * FROM {view}")
    finally:
        spark.catalog.dropTempView(view)
    return not existed


def clone_tables(spark: SparkSession, sources: Mapping[str, DataFrame], schema: str,
                 location: str | None = None, parallelism: int = 1) -> dict[str, bool]:
    """Clone every source into ``schema`` (created if absent). ``parallelism > 1`` submits the
    copies from a small driver thread pool, so small tables do not wait behind large ones."""
    create_schema(spark, schema, location)

    def one(item):
        name, df = item
        return name, snapshot_clone(spark, df, f"{schema}.{name}")

    if parallelism <= 1:
        return dict(one(i) for i in sources.items())
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return dict(pool.map(one, sources.items()))


def row_counts(spark: SparkSession, schema: str, names) -> DataFrame:
    """``table_name, row_count`` for the given tables of ``schema`` (one job, one union)."""
    out = None
    for n in names:
        c = spark.table(f"{schema}.{n}").agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
        out = c if out is None else out.unionByName(c)
    return out
