"""Reading the lake tables and the synced copies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidesync.contracts import CUSTOMER_VIEW_COLUMNS, ORDERS
from tidesync.operators.load import typed


def read_table(spark: SparkSession, root: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet table ``{root}/{name}.parquet``; an explicit projection reaches the scan."""
    df = spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def partsupp(lineitem: DataFrame) -> DataFrame:
    """The part-supplier pairs, derived from lineitem (the data set has no partsupp table)."""
    return lineitem.select(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).distinct()


def tpch_tables(spark: SparkSession, root: str, names: Sequence[str]) -> dict[str, DataFrame]:
    out = {}
    for n in names:
        out[n] = partsupp(read_table(spark, root, "lineitem")) if n == "partsupp" else read_table(spark, root, n)
    return out


def with_order_fields(orders: DataFrame) -> DataFrame:
    """Orders with the three contract columns the data set lacks, as fixed functions of the row:
    clerk ``Clerk#`` + key mod 1000 in 9 digits, ship priority 0, comment from priority and customer."""
    return orders.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
        F.concat(F.lit("Clerk#"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 9, "0")).alias("o_clerk"),
        F.lit(0).alias("o_shippriority"),
        F.concat(F.col("o_orderpriority"), F.lit(" order for customer "), F.col("o_custkey").cast("string")).alias("o_comment"),
    )


def lake_orders(spark: SparkSession, root: str) -> DataFrame:
    """The lake's ``orders`` under the order contract (typed, 9 columns)."""
    return typed(with_order_fields(read_table(spark, root, "orders")), ORDERS)


def customers_view(df: DataFrame) -> DataFrame:
    return df.select(*CUSTOMER_VIEW_COLUMNS)


def table_or_empty(spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
    """A catalog table, or an empty frame of the expected schema while it does not exist yet
    (a synced copy still warming up reads as empty instead of failing)."""
    if spark.catalog.tableExists(name):
        return spark.table(name)
    return spark.createDataFrame([], schema)


def seed_scan(orders: DataFrame, n: int = 100, key: str = "o_orderkey") -> DataFrame:
    """Seed candidates: the first ``n`` orders by key (the seed size is the feature)."""
    return orders.select(*ORDERS.columns).orderBy(key).limit(n)
