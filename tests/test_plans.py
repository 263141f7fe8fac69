"""Clone, publish, forward job and physical-plan shape."""

import uuid

import pytest

from helpers import order, orders_df
from tidesync.contracts import ORDERS
from tidesync.operators import changes, query
from tidesync.plans import clone, forward, publish
from tidesync.session import scratch_path
from tidesync.sources import fixtures, tables

SF = "/root/testdata/sf0.001"
KEY = ["o_orderkey"]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_clone_keeps_existing_target(spark):
    root = scratch_path(spark, "t-clone")
    db = "t_clone_" + uuid.uuid4().hex[:8]
    publish.create_schema(spark, db, f"{root}/db")
    assert clone.snapshot_clone(spark, orders_df(spark, [order(1)]), f"{db}.o") is True
    assert clone.snapshot_clone(spark, orders_df(spark, [order(1), order(2)]), f"{db}.o") is False
    assert spark.table(f"{db}.o").count() == 1


def test_contract_table_rejects_long_text(spark):
    root = scratch_path(spark, "t-contract")
    name = "t_contract_" + uuid.uuid4().hex[:8]
    publish.create_contract_table(spark, name, ORDERS, f"{root}/t")
    orders_df(spark, [order(1)]).write.insertInto(name)
    with pytest.raises(Exception):
        orders_df(spark, [order(2, comment="z" * 80)]).write.insertInto(name)
    assert spark.table(name).count() == 1


def test_forward_merge_publishes_and_short_circuits(spark):
    root = scratch_path(spark, "t-forward")
    name = "t_fwd_" + uuid.uuid4().hex[:8]
    publish.publish_swap(orders_df(spark, [order(1), order(2)]), name, root)
    run = forward.forward_merge(spark, orders_df(spark, []), name, root)
    assert run.status == "no_rows"
    run = forward.forward_merge(spark, orders_df(spark, [order(2, status="F"), order(3)]), name, root)
    assert run.status == "merged" and run.metrics["num_inserted_rows"] == 1 and run.metrics["num_updated_rows"] == 1
    got = {r["o_orderkey"]: r["o_orderstatus"] for r in spark.table(name).collect()}
    assert got == {1: "O", 2: "F", 3: "O"}
    assert publish.table_location(spark, name).rstrip("/").endswith(run.path.rsplit("/", 1)[-1])
    # re-run of the same staging: same target (idempotent)
    forward.forward_merge(spark, orders_df(spark, [order(2, status="F"), order(3)]), name, root)
    assert {r["o_orderkey"]: r["o_orderstatus"] for r in spark.table(name).collect()} == got


def test_merge_broadcast_plan_never_shuffles_target(spark):
    lake = tables.lake_orders(spark, SF)
    staged = fixtures.staging(lake)
    m = changes.merge(lake, staged, KEY)
    assert m.strategy == "broadcast"
    plan = plan_of(m.result)
    assert "SortMergeJoin" not in plan
    assert "BroadcastHashJoin" in plan


def test_merge_shuffle_plan_is_one_sort_merge_join(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lake = tables.lake_orders(spark, SF)
        m = changes.merge(lake, fixtures.staging(lake), KEY, strategy="shuffle")
        plan = m.result._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 1 and "FullOuter" in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_page_is_bounded_top_k(spark):
    lake = tables.lake_orders(spark, SF)
    plan = plan_of(query.page(lake, "o_orderkey", None, 50, 100))
    assert "TakeOrderedAndProject" in plan and "limit=150" in plan


def test_keyset_filter_reaches_scan(spark):
    raw = tables.read_table(spark, SF, "orders")
    plan = plan_of(query.keyset_page(raw, "o_orderkey", 149, 50))
    assert "GreaterThan(o_orderkey,149)" in plan


def test_projection_pruned_at_scan(spark):
    df = tables.read_table(spark, SF, "customer")
    plan = plan_of(query.page(df, "c_custkey", ["c_custkey", "c_name"], 10, 0))
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string>" in plan


def test_forward_merge_buckets_touches_only_staged_buckets(spark):
    from tidesync.plans import bucketed
    root = scratch_path(spark, "t-fwdb")
    name = "t_fwdb_" + uuid.uuid4().hex[:8]
    lake = tables.lake_orders(spark, SF)
    staged = fixtures.staging(lake)
    table = bucketed.create(spark, name, lake, KEY, 16, root)
    small = staged.where("o_orderkey % 70 = 0")
    before = {r["partition"]: None for r in spark.sql(f"SHOW PARTITIONS {name}").collect()}
    run = forward.forward_merge_buckets(spark, small, table)
    assert run.status == "merged" and 0 < run.metrics["touched_buckets"] <= 16
    got = sorted(map(tuple, table.read(spark).collect()))
    want = sorted(map(tuple, changes.merge(lake, small, KEY).result.collect()))
    assert got == want
    assert run.metrics["num_affected_rows"] == small.count()
    assert len(before) == 16


def test_catalog_merge_falls_back_on_parquet(spark):
    root = scratch_path(spark, "t-fwdc")
    name = "t_fwdc_" + uuid.uuid4().hex[:8]
    publish.publish_swap(orders_df(spark, [order(1), order(2)]), name, root)
    run = forward.forward_merge(spark, orders_df(spark, [order(2, status="F"), order(3)]), name, root,
                                use_catalog_merge=True)
    assert run.strategy in ("broadcast", "shuffle")        # Parquet has no MERGE: join plan used
    assert {r["o_orderkey"]: r["o_orderstatus"] for r in spark.table(name).collect()} == {1: "O", 2: "F", 3: "O"}


def test_bucketed_write_has_few_files_and_vacuum_keeps_referenced(spark):
    import os
    from tidesync.plans import bucketed, retention
    from tidesync.session import local_path
    root = scratch_path(spark, "t-vac")
    name = "t_vac_" + uuid.uuid4().hex[:8]
    lake = tables.lake_orders(spark, SF)
    table = bucketed.create(spark, name, lake, KEY, 4, root, files_per_bucket=2)
    first = [d for d in os.listdir(local_path(root)) if d.startswith("v-")]
    files = [f for dp, _, fs in os.walk(local_path(f"{root}/{first[0]}")) for f in fs if f.endswith(".parquet")]
    assert len(files) <= 4 * 2                                   # not tasks x buckets
    forward.forward_merge_buckets(spark, fixtures.staging(lake).where("o_orderkey % 700 = 0"), table)
    before = sorted(lake.collect()) and sorted(map(tuple, table.read(spark).collect()))
    # nothing is old enough yet
    assert retention.vacuum(spark, name, root, retain_seconds=3600) == []
    gone = retention.vacuum(spark, name, root, retain_seconds=0)
    refs = retention.referenced_paths(spark, name)
    assert all(not any(r.startswith(g) for r in refs) for g in gone)
    spark.sql(f"REFRESH TABLE {name}")
    assert sorted(map(tuple, table.read(spark).collect())) == before


def test_bucketed_write_splits_a_hot_bucket(spark):
    """Default layout (REBALANCE): a bucket holding a third of all rows is written by several
    tasks, not one; small buckets stay in few files; no row is lost."""
    import os
    from pyspark.sql import functions as F
    from tidesync.plans import bucketed
    from tidesync.session import local_path
    lake = tables.lake_orders(spark, "/root/testdata/sf0.01")
    hot = F.when(F.col("o_orderkey") % 3 == 0, F.lit(0)).otherwise(F.col("o_orderkey"))
    df = lake.withColumn("k", hot.cast("long")).repartition(16)          # many map tasks, as on a cluster
    path = scratch_path(spark, "t-hot") + "/t"
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(64 * 1024))
    try:
        bucketed._write_buckets(df, ["k"], ["bigint"], 8, 8, None, path)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    hot_bucket = df.where("k = 0").select(bucketed.bucket_of(["k"], 8, ["bigint"]).alias("b")).first()["b"]
    files = {b: [f for f in os.listdir(local_path(f"{path}/{bucketed.BUCKET}={b}")) if f.endswith(".parquet")]
             for b in range(8)}
    assert len(files[hot_bucket]) > 1
    assert spark.read.parquet(path).count() == df.count()


def test_hot_key_is_reduced_before_the_shuffle(spark):
    """One key holding a third of all rows: the one-row-per-key reduction and the duplicate check
    give the right rows, and both aggregate map-side before the exchange (no task gathers the
    whole key)."""
    from pyspark.sql import functions as F
    from tidesync.operators.dedupe import duplicate_keys, latest_per_key
    lake = tables.lake_orders(spark, "/root/testdata/sf0.01")
    hot = lake.withColumn("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(0).cast("long"))
                          .otherwise(F.col("o_orderkey"))).repartition(8)
    n_hot = lake.where("o_orderkey % 3 = 0").count()
    latest = latest_per_key(hot, KEY, ["o_totalprice", "o_custkey"])
    want = lake.where("o_orderkey % 3 = 0").orderBy(F.col("o_totalprice").desc(), F.col("o_custkey").desc()).first()
    got = latest.where("o_orderkey = 0").collect()
    assert len(got) == 1 and (got[0]["o_totalprice"], got[0]["o_custkey"]) == (want["o_totalprice"], want["o_custkey"])
    assert latest.count() == lake.count() - n_hot + 1
    dups = duplicate_keys(hot, KEY).collect()
    assert [(r["o_orderkey"], r["n_rows"]) for r in dups] == [(0, n_hot)]
    for df in (latest, duplicate_keys(hot, KEY)):
        text = df._jdf.queryExecution().executedPlan().toString()
        partial = max(text.find("partial_max"), text.find("partial_count"))
        assert partial > text.find("Exchange hashpartitioning(o_orderkey") > 0


def test_shared_root_comes_from_the_session(spark):
    from tidesync.session import shared_root
    root = shared_root(spark)
    assert root == spark.sparkContext.getCheckpointDir().rstrip("/")
    assert scratch_path(spark, "x").startswith(root + "/tidesync/x-")


def test_forward_merge_repeated_staging_keys(spark):
    from tidesync.operators.dedupe import DuplicateKeyError
    root = scratch_path(spark, "t-fwd-dup")
    name = "t_fwd_dup_" + uuid.uuid4().hex[:8]
    publish.publish_swap(orders_df(spark, [order(1), order(2)]), name, root)
    staged = orders_df(spark, [order(2, status="F", price="5.00"), order(2, status="P", price="7.00"), order(3)])
    with pytest.raises(DuplicateKeyError):
        forward.forward_merge(spark, staged, name, root)
    assert sorted(r["o_orderkey"] for r in spark.table(name).collect()) == [1, 2]     # nothing published
    run = forward.forward_merge(spark, staged, name, root, on_duplicate="latest", order_by=["o_totalprice"])
    assert run.metrics["num_updated_rows"] == 1 and run.metrics["num_inserted_rows"] == 1
    assert run.metrics["fetched_rows"] == 3                                            # rows read from staging
    got = {r["o_orderkey"]: r["o_orderstatus"] for r in spark.table(name).collect()}
    assert got == {1: "O", 2: "P", 3: "O"}


def test_forward_refuses_a_partitioned_target(spark):
    root = scratch_path(spark, "t-part")
    name = "t_part_" + uuid.uuid4().hex[:8]
    rows = orders_df(spark, [order(1), order(2, status="F")])
    rows.write.partitionBy("o_orderstatus").option("path", f"{root}/table").saveAsTable(name)
    with pytest.raises(ValueError, match="partitioned"):
        forward.forward_merge(spark, orders_df(spark, [order(3)]), name, root)
    assert spark.table(name).count() == 2


def test_forward_rejects_bad_rows_and_repeats_alike(spark):
    root = scratch_path(spark, "t-rej")
    name = "t_rej_" + uuid.uuid4().hex[:8]
    publish.publish_swap(orders_df(spark, [order(1), order(2)]), name, root)
    from pyspark.sql import functions as F
    staged = orders_df(spark, [order(2, status="F"), order(3)])
    bad = staged.withColumn("o_orderkey", F.lit(None).cast("long")).limit(1).unionByName(
        staged.withColumn("o_comment", F.repeat(F.lit("c"), F.lit(200))).limit(1))
    for _ in range(2):
        run = forward.forward_merge(spark, staged.unionByName(bad), name, root)
        assert run.metrics["rejected_rows"] == 2 and run.metrics["fetched_rows"] == 4
        assert sorted(r["reason"] for r in spark.read.parquet(run.rejects).collect()) == ["missing_key:o_orderkey", "too_long:o_comment"]
        assert {r["o_orderkey"]: r["o_orderstatus"] for r in spark.table(name).collect()} == {1: "O", 2: "F", 3: "O"}
    only_bad = forward.forward_merge(spark, bad, name, root)
    assert only_bad.status == "no_rows" and spark.read.parquet(only_bad.rejects).count() == 2


def test_vacuum_leaves_what_is_not_its_own(spark):
    """Two tables and a checkpoint folder under one root: only old versions of the named table go."""
    from tidesync.plans import retention
    root = scratch_path(spark, "t-own")
    a, b = ("t_own_" + uuid.uuid4().hex[:8] for _ in range(2))
    old = publish.publish_swap(orders_df(spark, [order(1)]), a, root)
    publish.publish_swap(orders_df(spark, [order(1), order(2)]), a, root)
    publish.publish_swap(orders_df(spark, [order(3)]), b, root)
    spark.range(3).write.parquet(f"{root}/checkpoint/state")
    gone = retention.vacuum(spark, a, root, retain_seconds=0)
    assert [g.rsplit("/", 1)[-1] for g in gone] == [old.rsplit("/", 1)[-1]]
    assert spark.table(a).count() == 2 and spark.table(b).count() == 1
    assert spark.read.parquet(f"{root}/checkpoint/state").count() == 3
