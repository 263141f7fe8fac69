"""Publishing a new table state on plain Parquet tables.

Spark cannot overwrite a table it is reading, and plain Parquet has no MERGE/UPDATE/DELETE, so a
new state is written to a fresh folder and the catalog entry is pointed at it in one call
(``ALTER TABLE ... SET LOCATION``). Readers see the old or the new version, never a mix. Writing
the new state also cuts the lineage of the change plan.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from tidesync.contracts import TableContract


def create_schema(spark: SparkSession, name: str, location: str | None = None) -> None:
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}{loc}")


def create_contract_table(spark: SparkSession, name: str, contract: TableContract, location: str | None = None) -> None:
    """``CREATE TABLE IF NOT EXISTS`` with the contract's columns; CHAR/VARCHAR limits are kept, so
    Spark itself rejects over-long text on insert. Key and default are enforced by the operators."""
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({contract.ddl()}) USING parquet{loc}")


def table_location(spark: SparkSession, name: str) -> str | None:
    if not spark.catalog.tableExists(name):
        return None
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()
    for r in rows:
        if r["col_name"] == "Location":
            return r["data_type"]
    return None


def owner_file(spark: SparkSession, table: str) -> str:
    """Name of the marker in every folder written for ``table``; ``vacuum`` deletes only such folders."""
    parts = table.replace("`", "").lower().split(".")[-2:]
    if len(parts) == 1:
        parts.insert(0, spark.catalog.currentDatabase())
    return "_owner." + re.sub(r"[^\w.]", "_", ".".join(parts))


def mark_owner(spark: SparkSession, path: str, table: str) -> None:
    """Leave the owner marker in ``path`` (readers ignore it). Without the JVM's file system, as over
    Spark Connect, no marker is left and the folder is never vacuumed."""
    if not hasattr(spark, "_jsparkSession"):
        return
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, owner_file(spark, table))
    marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(marker).close()


def refuse_partitioned(spark: SparkSession, table: str) -> None:
    """A location swap moves no partition, so its rows would not be seen: refuse such a table."""
    if spark.catalog.tableExists(table) and any(c.isPartition for c in spark.catalog.listColumns(table)):
        raise ValueError(f"{table} is partitioned; a location swap cannot publish it (use a key-bucketed table)")


def publish_swap(df: DataFrame, table: str, root: str, version: str | None = None) -> str:
    """Write ``df`` to a fresh folder ``{root}/{version}`` and make ``table`` point at it. Returns the path.

    The folder must not exist yet, so files that readers still use are never overwritten.
    """
    spark = df.sparkSession
    refuse_partitioned(spark, table)
    path = f"{root.rstrip('/')}/{version or 'v-' + uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    mark_owner(spark, path, table)
    if spark.catalog.tableExists(table):
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{path}'")
        spark.sql(f"REFRESH TABLE {table}")
    else:
        spark.sql(f"CREATE TABLE {table} USING parquet LOCATION '{path}'")
    return path


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` once to ``path`` (a folder below the shared root) and read it back.

    For inputs a job reads more than once: a serving table scanned over JDBC is then read once,
    every later step sees the same rows (the table may change while the job runs), and the
    lineage is cut, so a lost executor re-reads files instead of re-running the source query.
    """
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """Rows out as JSON lines."""
    df.write.mode("overwrite").json(path)
