import datetime as dt
from decimal import Decimal

from pyspark.sql import types as T

from tidesync.contracts import ORDERS


def order(k, cust=1, status="O", price="10.00", date=dt.date(1996, 1, 2), prio="1-URGENT",
          clerk="Clerk#000000001", ship=0, comment="c"):
    return (k, cust, status, None if price is None else Decimal(price), date, prio, clerk, ship, comment)


def orders_df(spark, rows):
    return spark.createDataFrame(rows, ORDERS.schema)


def patch_df(spark, rows):
    return spark.createDataFrame(rows, ORDERS.patch_schema())


def by_key(df, key="o_orderkey"):
    return {r[key]: r.asDict() for r in df.collect()}


STAGING_SCHEMA = T.StructType(list(ORDERS.schema.fields) + [T.StructField("last_modified", T.TimestampType(), True)])
