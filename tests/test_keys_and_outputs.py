"""Bucket hashing by stored key type, repeated target keys, one-read inserts, ingest of empty texts, timed sync."""

import time
import uuid

import pytest
from pyspark.sql import functions as F

from helpers import STAGING_SCHEMA, by_key, order, orders_df
from test_sync import COLS, KEY, with_meta
from tidesync.contracts import ORDERS
from tidesync.operators import changes
from tidesync.plans import bucketed, publish
from tidesync.session import scratch_path
from tidesync.sources import ingest
from tidesync.streaming import sync


def bucket_table(spark, df, key=("k",), buckets=8):
    root = scratch_path(spark, "t-keys")
    name = "t_keys_" + uuid.uuid4().hex[:8]
    return bucketed.create(spark, name, df, list(key), buckets, root)


def merge_into(spark, table, batch):
    table = bucketed.open_table(spark, table.name, table.root)
    bucketed.apply(spark, table, batch, lambda cur, ch: changes.merge(cur, ch, list(table.key)).result)
    return {r["k"]: r["v"] for r in table.read(spark).collect()}


@pytest.mark.parametrize("stored, given", [
    ("decimal(12,2)", "decimal(12,0)"), ("decimal(12,0)", "decimal(18,4)"), ("int", "bigint"), ("bigint", "int"),
    ("bigint", "decimal(12,0)"), ("string", "int"), ("date", "timestamp"),
])
def test_equal_keys_of_other_types_find_their_bucket(spark, stored, given):
    ids = spark.range(60)
    key = F.date_add(F.lit("2001-01-01").cast("date"), F.col("id").cast("int")) if stored == "date" else F.col("id")
    table = bucket_table(spark, ids.select(key.cast(stored).alias("k"), F.lit("old").alias("v")))
    batch = ids.where("id < 10").select(key.cast(given).alias("k"), F.lit("new").alias("v"))
    got = merge_into(spark, table, batch)
    assert len(got) == 60 and sorted(got.values()).count("new") == 10


def test_timestamp_keys_do_not_depend_on_the_time_zone(spark):
    df = spark.range(100).select(F.timestamp_seconds(F.col("id") * 86_413).alias("k"), F.lit("old").alias("v"))
    table = bucket_table(spark, df)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = merge_into(spark, table, df.limit(30).withColumn("v", F.lit("new")))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert len(got) == 100 and list(got.values()).count("new") == 30


def test_tables_with_another_hash_are_refused(spark):
    table = bucket_table(spark, spark.range(5).select(F.col("id").alias("k"), F.lit("v").alias("v")))
    spark.sql(f"ALTER TABLE {table.name} UNSET TBLPROPERTIES ('{bucketed.PROP_HASH}')")
    with pytest.raises(bucketed.UnknownHashError):
        bucketed.open_table(spark, table.name, table.root)


def test_rows_outside_the_touched_buckets_stop_the_batch(spark):
    table = bucket_table(spark, spark.range(50).select(F.col("id").alias("k"), F.lit("old").alias("v")))
    batch = spark.createDataFrame([(1, "new")], "k long, v string")
    with pytest.raises(ValueError, match="nothing was published"):
        bucketed.apply(spark, table, batch, lambda cur, ch: cur.withColumn("k", F.col("k") + 1))
    assert {r["v"] for r in table.read(spark).collect()} == {"old"}


@pytest.mark.parametrize("strategy", ["broadcast", "shuffle"])
def test_a_repeated_target_key_matches_once(spark, strategy):
    target = spark.range(3000).select((F.col("id") % 3).alias("k"), F.col("id").alias("i"), F.lit("a").alias("v"))
    source = spark.createDataFrame([(0, -1, "b"), (9, -2, "c")], "k long, i long, v string")
    m = changes.merge(target, source, ["k"], strategy=strategy, observe=True)
    rows = m.result.collect()
    assert len(rows) == 3001 and sum(r["v"] == "b" for r in rows) == 1000
    assert sorted(map(tuple, m.classes.collect())) == [(0, "update"), (9, "insert")]
    assert m.observed_metrics()["num_updated_rows"] == 1000 and m.observed_metrics()["num_inserted_rows"] == 1


def test_pinned_insert_equals_the_plain_one(spark):
    target = spark.createDataFrame([(*order(i), None) for i in range(10)], STAGING_SCHEMA)
    batch = orders_df(spark, [order(5), order(20), order(21), order(21, status="F"), order(22, comment=None)])
    stamp = ("last_modified", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    path = scratch_path(spark, "t-pin")
    plain = changes.insert_strict(target, batch, KEY, stamp=stamp)
    pinned = changes.insert_strict(target, batch, KEY, stamp=stamp, pin=lambda df: publish.materialize(df, path))
    for part in ("result", "inserted", "conflicts"):
        a, b = getattr(plain, part), getattr(pinned, part)
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert {r["o_orderkey"]: r["last_modified"].year for r in pinned.inserted.collect()} == {20: 2024, 22: 2024}


def test_ingest_keeps_empty_texts(spark):
    records = spark.createDataFrame([('{"o_orderkey": 1, "o_orderstatus": "", "o_comment": ""}',)], "value string")
    row = by_key(ingest.parse_records(records, ORDERS).accepted)[1]
    assert row["o_orderstatus"] == "" and row["o_comment"] == "" and row["o_clerk"] is None


def test_a_scheduled_sync_takes_later_files(spark):
    """``processingTime`` keeps running: a file that lands after the start reaches the copy."""
    root = scratch_path(spark, "t-timed")
    with_meta(orders_df(spark, [order(1)]), 1).select(*COLS).coalesce(1).write.parquet(f"{root}/feed")
    schema = spark.read.parquet(f"{root}/feed").schema
    q = sync.sync_files(spark, f"{root}/feed", schema, "unused", f"{root}/table", KEY, f"{root}/ckpt",
                        layout="log", trigger={"processingTime": "1 second"})
    try:
        q.processAllAvailable()
        with_meta(orders_df(spark, [order(2)]), 2).select(*COLS).coalesce(1).write.mode("append").parquet(f"{root}/feed")
        deadline = time.time() + 60
        while sync.read_log(spark, f"{root}/table").count() < 2 and time.time() < deadline:
            time.sleep(0.5)
    finally:
        q.stop()
    assert sorted(r["o_orderkey"] for r in sync.read_log(spark, f"{root}/table").collect()) == [1, 2]
