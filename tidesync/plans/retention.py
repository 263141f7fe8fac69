"""Retention of published versions.

Every publish writes a new version folder under the table's root and leaves the old one in
place, so that queries planned before the swap keep reading consistent files. This removes the
version folders that the table no longer references once they are older than a grace period
(longer than any query may run). Only folders that carry the table's owner marker are touched, so
other tables, checkpoints and rejects below the same root stay. It uses the Hadoop FileSystem of the root's scheme, like
Spark's own writers, so it works on any shared store Spark can write to.
"""

from __future__ import annotations

import time

from pyspark.sql import SparkSession

from tidesync.plans import bucketed
from tidesync.plans.publish import owner_file, table_location


def _fs(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path, jvm


def _norm(p: str) -> str:
    return p.replace("file:///", "file:/").rstrip("/")


def referenced_paths(spark: SparkSession, table: str) -> set[str]:
    """Folders the table reads now: its location and, if partitioned, every partition's."""
    refs = {_norm(table_location(spark, table) or "")}
    if spark.sql(f"SHOW TBLPROPERTIES {table}").where(f"key = '{bucketed.PROP_BUCKETS}'").count():
        refs |= {_norm(p) for p in bucketed.partition_locations(spark, table).values()}
    return {r for r in refs if r}


def vacuum(spark: SparkSession, table: str, root: str, retain_seconds: float = 7 * 24 * 3600,
           dry_run: bool = False) -> list[str]:
    """Delete folders directly under ``root`` that carry the table's owner marker, hold no referenced
    path and were last modified more than ``retain_seconds`` ago. Returns the folders deleted (or to delete)."""
    fs, path, jvm = _fs(spark, root)
    if not fs.exists(path):
        return []
    refs = referenced_paths(spark, table)
    marker = owner_file(spark, table)
    cutoff_ms = (time.time() - retain_seconds) * 1000
    gone = []
    for st in fs.listStatus(path):
        if not st.isDirectory():
            continue
        folder = _norm(st.getPath().toString())
        if not fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), marker)):
            continue                                          # not written for this table
        if any(r == folder or r.startswith(folder + "/") for r in refs):
            continue
        if st.getModificationTime() > cutoff_ms:
            continue
        gone.append(folder)
        if not dry_run:
            fs.delete(st.getPath(), True)
    return gone
