"""Continuous keyed sync: stream end state = batch end state, seq rule, tombstones, replays."""

import uuid

import pytest
from pyspark.sql import functions as F

from helpers import order, orders_df
from tidesync.contracts import ORDERS
from tidesync.operators import changes
from tidesync.session import scratch_path
from tidesync.sources import fixtures, tables
from tidesync.streaming import sync

SF = "/root/testdata/sf0.001"
KEY = ["o_orderkey"]
COLS = ORDERS.columns + ["seq", "op"]


def run_sync(spark, parts, max_files):
    root = scratch_path(spark, "t-sync")
    feed = f"{root}/feed"
    for p in parts:
        p.select(*COLS).coalesce(1).write.mode("append").parquet(feed)
    name = "t_sync_" + uuid.uuid4().hex[:8]
    schema = spark.read.parquet(feed).schema
    q = sync.sync_files(spark, feed, schema, name, f"{root}/table", KEY, f"{root}/ckpt",
                        max_files_per_trigger=max_files)
    q.awaitTermination()
    assert q.exception() is None
    return name, root, feed, schema


def with_meta(df, seq, op=None):
    return df.withColumn("seq", F.lit(seq).cast("long")).withColumn("op", F.lit(op).cast("string"))


@pytest.mark.parametrize("max_files", [1, 2, 10])
def test_stream_equals_batch_for_any_split(spark, max_files):
    lake = tables.lake_orders(spark, SF)
    staged = fixtures.staging(lake)
    parts = [with_meta(lake, 0)] + [p.withColumn("op", F.lit(None).cast("string"))
                                    for p in fixtures.change_feed_parts(staged, 4)[::-1]]
    name, *_ = run_sync(spark, parts, max_files)
    got = sorted(map(tuple, sync.live_rows(spark.table(name)).collect()))
    want = sorted(map(tuple, changes.merge(lake, staged, KEY).result.collect()))
    assert got == want


def test_seq_rule_and_tombstones(spark):
    base = with_meta(orders_df(spark, [order(1), order(2), order(3)]), 1)
    newer = with_meta(orders_df(spark, [order(1, status="F")]), 5)
    delete = with_meta(orders_df(spark, [order(2)]), 5, "D")
    late_old = with_meta(orders_df(spark, [order(1, status="P"), order(2, status="P")]), 3)   # arrives last, older
    name, *_ = run_sync(spark, [base, newer, delete, late_old], 1)
    got = {r["o_orderkey"]: r["o_orderstatus"] for r in sync.live_rows(spark.table(name)).collect()}
    assert got == {1: "F", 3: "O"}                 # late older change neither wins nor revives key 2


def test_replayed_batch_is_skipped(spark):
    base = with_meta(orders_df(spark, [order(1)]), 1)
    name, root, feed, schema = run_sync(spark, [base], 1)
    loc_before = sync.table_location(spark, name)
    writer = sync.sync_batch_writer(name, f"{root}/table", KEY)
    replay = spark.read.schema(schema).parquet(feed).withColumn("o_orderstatus", F.lit("X"))
    writer(replay, 0)                              # batch 0 again: already published
    assert sync.table_location(spark, name) == loc_before
    assert spark.table(name).first()["o_orderstatus"] == "O"


def run_sync_buckets(spark, parts, max_files, buckets=8):
    root = scratch_path(spark, "t-syncb")
    feed = f"{root}/feed"
    for p in parts:
        p.select(*COLS).coalesce(1).write.mode("append").parquet(feed)
    name = "t_syncb_" + uuid.uuid4().hex[:8]
    schema = spark.read.parquet(feed).schema
    q = sync.sync_files(spark, feed, schema, name, f"{root}/table", KEY, f"{root}/ckpt",
                        max_files_per_trigger=max_files, layout="buckets", buckets=buckets)
    q.awaitTermination()
    assert q.exception() is None
    return name, root, feed, schema


@pytest.mark.parametrize("max_files", [1, 3])
def test_bucketed_stream_equals_batch(spark, max_files):
    lake = tables.lake_orders(spark, SF)
    staged = fixtures.staging(lake)
    parts = [with_meta(lake, 0)] + [p.withColumn("op", F.lit(None).cast("string"))
                                    for p in fixtures.change_feed_parts(staged, 4)[::-1]]
    name, *_ = run_sync_buckets(spark, parts, max_files)
    got = sorted(map(tuple, sync.live_rows(spark.table(name)).collect()))
    want = sorted(map(tuple, changes.merge(lake, staged, KEY).result.collect()))
    assert got == want


def test_bucketed_seq_rule_and_replay(spark):
    base = with_meta(orders_df(spark, [order(i) for i in range(1, 40)]), 1)
    newer = with_meta(orders_df(spark, [order(1, status="F")]), 5)
    delete = with_meta(orders_df(spark, [order(2)]), 5, "D")
    late_old = with_meta(orders_df(spark, [order(1, status="P"), order(2, status="P")]), 3)
    name, root, feed, schema = run_sync_buckets(spark, [base, newer, delete, late_old], 1, buckets=4)
    got = {r["o_orderkey"]: r["o_orderstatus"] for r in sync.live_rows(spark.table(name)).collect()}
    assert got[1] == "F" and 2 not in got and len(got) == 38
    writer = sync.sync_batch_writer(name, f"{root}/table", KEY, layout="buckets", buckets=4)
    writer(with_meta(orders_df(spark, [order(3, status="X")]), 9), 2)     # batch 2 already applied
    assert {r["o_orderkey"]: r["o_orderstatus"] for r in sync.live_rows(spark.table(name)).collect()} == got


def test_apply_changes_seq_rule_in_batch(spark):
    """The seq rule as one MERGE: higher seq wins, equal or lower seq is kept, a change without
    seq never replaces a stored seq, a stored row without seq takes any change, new keys insert."""
    stored = spark.createDataFrame(
        [with_meta_row(order(1), 5), with_meta_row(order(2), 5), with_meta_row(order(3), 5),
         with_meta_row(order(4), None)], spark_cols(spark))
    batch = spark.createDataFrame(
        [with_meta_row(order(1, status="F"), 6), with_meta_row(order(2, status="F"), 5),
         with_meta_row(order(3, status="F"), None), with_meta_row(order(4, status="F"), 1),
         with_meta_row(order(5, status="F"), None)], spark_cols(spark))
    got = {r["o_orderkey"]: (r["o_orderstatus"], r["seq"])
           for r in sync.apply_changes(stored, batch, KEY, "seq").collect()}
    assert got == {1: ("F", 6), 2: ("O", 5), 3: ("O", 5), 4: ("F", 1), 5: ("F", None)}


def with_meta_row(row, seq, op=None):
    return (*row, seq, op)


def spark_cols(spark):
    from pyspark.sql import types as T
    return T.StructType(list(ORDERS.schema.fields) + [T.StructField("seq", T.LongType(), True),
                                                      T.StructField("op", T.StringType(), True)])


@pytest.mark.parametrize("layout", ["swap", "buckets"])
def test_new_checkpoint_loses_no_batch(spark, layout):
    """A second query on the copy starts at batch 0 again; its changes are applied, and the session
    that reads the copy sees them without a refresh of its own."""
    root = scratch_path(spark, "t-two")
    name = "t_two_" + uuid.uuid4().hex[:8]
    for n in range(2):
        feed = f"{root}/feed-{n}"
        for k in (2 * n + 1, 2 * n + 2):
            with_meta(orders_df(spark, [order(k)]), k).select(*COLS).coalesce(1).write.mode("append").parquet(feed)
        schema = spark.read.parquet(feed).schema
        for _ in range(2):                                     # the second start finds nothing new
            q = sync.sync_files(spark, feed, schema, name, f"{root}/table", KEY, f"{root}/ckpt-{n}", layout=layout)
            q.awaitTermination()
            assert q.exception() is None
        got = sorted(r["o_orderkey"] for r in sync.live_rows(spark.table(name)).collect())
        assert got == list(range(1, 2 * n + 3))


def test_backfill_lost_halfway_is_applied_on_replay(spark, monkeypatch):
    """The driver dies after CREATE TABLE, before the partitions are known: the replayed batch
    brings all rows."""
    from pyspark.sql import SparkSession

    root = scratch_path(spark, "t-lost")
    name = "t_lost_" + uuid.uuid4().hex[:8]
    batch = with_meta(orders_df(spark, [order(i) for i in range(1, 30)]), 1)
    writer = sync.sync_batch_writer(name, f"{root}/table", KEY, layout="buckets", buckets=4)
    plain = SparkSession.sql

    def failing(self, text, *a, **kw):
        if text.startswith("MSCK"):
            raise RuntimeError("driver lost")
        return plain(self, text, *a, **kw)

    monkeypatch.setattr(type(spark), "sql", failing)
    with pytest.raises(RuntimeError):
        writer(batch, 0)
    monkeypatch.undo()
    writer(batch, 0)
    assert sync.live_rows(spark.table(name)).count() == 29


def test_change_files_are_computed_by_many_tasks(spark):
    rows = orders_df(spark, [order(k) for k in range(400)]).repartition(8)
    one = fixtures.change_files(rows, KEY)
    # the tasks of the source stay, and one task writes the shuffled part
    assert one.rdd.getNumPartitions() == 1 and "Coalesce" not in one._jdf.queryExecution().toString()
    assert "Exchange" in one._jdf.queryExecution().executedPlan().toString()
    several = fixtures.change_files(rows, KEY, most_bytes=fixtures.measure(rows).bytes // 3)
    assert several.rdd.getNumPartitions() == 4
    assert sorted(several.collect()) == sorted(rows.collect()) == sorted(one.collect())
