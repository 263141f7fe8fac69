"""Edge cases and properties of the change operators."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from helpers import STAGING_SCHEMA, by_key, order, orders_df, patch_df
from tidesync.operators import changes
from tidesync.operators.dedupe import DuplicateKeyError

KEY = ["o_orderkey"]
AS_OF = dt.datetime(2024, 6, 30, 12, 0, 0)


@pytest.fixture(scope="module")
def target(spark):
    return orders_df(spark, [order(1), order(2, clerk="Clerk#000000002"), order(3)])


@pytest.mark.parametrize("strategy", ["broadcast", "shuffle"])
def test_merge_null_overwrites_and_unmatched_kept(spark, target, strategy):
    src = orders_df(spark, [order(2, clerk=None, price="99.99"), order(7, comment="new")])
    m = changes.merge(target, src, KEY, strategy=strategy)
    got = by_key(m.result)
    assert sorted(got) == [1, 2, 3, 7]
    assert got[2]["o_clerk"] is None                     # NULL in the source overwrites
    assert got[2]["o_totalprice"] == Decimal("99.99")
    assert got[1]["o_clerk"] == "Clerk#000000001"        # target rows without source kept
    assert got[7]["o_comment"] == "new"
    metrics = m.metrics().first().asDict()
    assert metrics == {"num_affected_rows": 2, "num_updated_rows": 1, "num_deleted_rows": 0, "num_inserted_rows": 1}
    assert m.strategy == strategy


def test_merge_picks_broadcast_for_small_source(spark, target):
    src = orders_df(spark, [order(2)])
    assert changes.merge(target, src, KEY).strategy == "broadcast"


def test_merge_shuffle_when_over_limit(spark, target):
    spark.conf.set("tidesync.broadcast.maxBytes", "10")
    try:
        src = orders_df(spark, [order(2), order(9)])
        m = changes.merge(target, src, KEY)
        assert m.strategy == "shuffle"
        assert sorted(by_key(m.result)) == [1, 2, 3, 9]
    finally:
        spark.conf.unset("tidesync.broadcast.maxBytes")


def test_merge_duplicate_source_keys(spark, target):
    src = orders_df(spark, [order(2, comment="a"), order(2, comment="b"), order(8)])
    with pytest.raises(DuplicateKeyError):
        changes.merge(target, src, KEY)
    src2 = src.withColumn("v", F.when(F.col("o_comment") == "a", 2).otherwise(1))
    tgt2 = target.withColumn("v", F.lit(0))
    m = changes.merge(tgt2, src2, KEY, on_duplicate="latest", order_by=["v"])
    assert by_key(m.result)[2]["o_comment"] == "a"


def test_merge_idempotent_and_sizes(spark, target):
    src = orders_df(spark, [order(1, status="F"), order(5), order(6)])
    once = changes.merge(target, src, KEY).result
    twice = changes.merge(once, src, KEY).result
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    assert once.count() == target.count() + 2
    assert once.select("o_orderkey").distinct().count() == once.count()


def test_merge_empty_source_leaves_target(spark, target):
    src = orders_df(spark, [])
    m = changes.merge(target, src, KEY)
    assert sorted(map(tuple, m.result.collect())) == sorted(map(tuple, target.collect()))
    assert m.metrics().first()["num_affected_rows"] == 0


def test_merge_target_extra_column(spark):
    tgt = spark.createDataFrame([order(1) + (AS_OF,)], STAGING_SCHEMA)
    src = orders_df(spark, [order(1, status="F"), order(4)])
    got = by_key(changes.merge(tgt, src, KEY).result)
    assert got[1]["last_modified"] == AS_OF and got[1]["o_orderstatus"] == "F"
    assert got[4]["last_modified"] is None


def test_merge_composite_key(spark):
    t = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k1 long, k2 int, v string")
    s = spark.createDataFrame([(1, 2, "B"), (2, 2, "D")], "k1 long, k2 int, v string")
    got = sorted(map(tuple, changes.merge(t, s, ["k1", "k2"]).result.collect()))
    assert got == [(1, 1, "a"), (1, 2, "B"), (2, 1, "c"), (2, 2, "D")]


def test_merge_source_column_not_in_target(spark, target):
    with pytest.raises(ValueError):
        changes.merge(target, orders_df(spark, [order(1)]).withColumn("zz", F.lit(1)), KEY)


def test_patch_rules(spark):
    tgt = spark.createDataFrame([order(1) + (None,), order(2) + (None,), order(3) + (None,)], STAGING_SCHEMA)
    p = patch_df(spark, [
        (1, None, "P", Decimal("0.00"), None, None, "", None, None),   # 0 and '' are applied
        (2, None, None, None, None, None, None, None, None),           # no field
        (9, None, "F", None, None, None, None, None, None),            # unknown key
    ])
    r = changes.patch_update(tgt, p, KEY, stamp=("last_modified", F.lit(AS_OF).cast("timestamp")))
    got = by_key(r.result)
    assert got[1]["o_orderstatus"] == "P" and got[1]["o_totalprice"] == Decimal("0.00") and got[1]["o_clerk"] == ""
    assert got[1]["o_comment"] == "c" and got[1]["o_custkey"] == 1          # NULL fields keep value
    assert got[1]["last_modified"] == AS_OF
    assert got[2]["last_modified"] is None and got[3]["last_modified"] is None
    assert {r["o_orderkey"]: r["outcome"] for r in r.outcomes.collect()} == {1: "applied", 2: "no_fields", 9: "not_found"}
    changed = r.changed.collect()
    assert [c["o_orderkey"] for c in changed] == [1]


def test_patch_duplicates_fold_or_reject(spark, target):
    p = patch_df(spark, [(1, None, "P", None, None, None, None, None, None),
                         (1, None, "F", None, None, None, "x", None, None)])
    r = changes.patch_update(target, p, KEY)
    assert {x["outcome"] for x in r.outcomes.collect()} == {"duplicate_in_batch"}
    assert by_key(r.result)[1]["o_orderstatus"] == "O"
    seq = p.withColumn("seq", F.when(F.col("o_orderstatus") == "P", 2).otherwise(1))
    seq = seq.withColumn("o_clerk", F.col("o_clerk"))
    r2 = changes.patch_update(target, seq, KEY, order_by="seq")
    got = by_key(r2.result)[1]
    assert got["o_orderstatus"] == "P" and got["o_clerk"] == "x"        # field-wise last non-NULL


def test_insert_strict_conflicts(spark, target):
    batch = orders_df(spark, [order(1), order(10), order(11, comment="a"), order(11, comment="b")])
    r = changes.insert_strict(target, batch, KEY)
    assert sorted(by_key(r.inserted)) == [10]
    assert {(c["o_orderkey"], c["reason"]) for c in r.conflicts.collect()} == {(1, "exists"), (11, "duplicate_in_batch")}
    assert r.result.count() == 4


def test_insert_strict_stamp(spark):
    tgt = spark.createDataFrame([order(1) + (None,)], STAGING_SCHEMA)
    r = changes.insert_strict(tgt, orders_df(spark, [order(5)]), KEY,
                              stamp=("last_modified", F.lit(AS_OF).cast("timestamp")))
    assert by_key(r.inserted)[5]["last_modified"] == AS_OF


def test_delete(spark, target):
    keys = spark.createDataFrame([(2,), (2,), (42,)], "o_orderkey long")
    r = changes.delete_by_keys(target, keys, KEY)
    assert sorted(by_key(r.result)) == [1, 3]
    assert {x["o_orderkey"]: x["outcome"] for x in r.outcomes.collect()} == {2: "deleted", 42: "not_found"}


def test_insert_if_absent_counts(spark, target):
    cand = orders_df(spark, [order(1, comment="never"), order(4), order(4, comment="z"), order(5)])
    r = changes.insert_if_absent(target, cand, KEY)
    counts = r.counts.first().asDict()
    assert counts == {"seeded": 2, "attempted": 4}
    got = by_key(r.result)
    assert got[1]["o_comment"] == "c"                    # existing row never overwritten
    assert sorted(got) == [1, 2, 3, 4, 5]


def test_seed_empty_staging_then_merge_is_noop(spark, target):
    empty = orders_df(spark, [])
    seeded = changes.insert_if_absent(empty, empty, KEY)
    assert seeded.counts.first().asDict() == {"seeded": 0, "attempted": 0}
    merged = changes.merge(target, seeded.result, KEY).result
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, target.collect()))


@pytest.mark.parametrize("strategy", ["broadcast", "shuffle"])
def test_merge_newer_than(spark, strategy):
    ts = lambda d: dt.datetime(2024, 1, d)
    tgt = spark.createDataFrame([order(1) + (ts(5),), order(2) + (ts(5),), order(3) + (None,)], STAGING_SCHEMA)
    src = spark.createDataFrame([order(1, status="F") + (ts(9),), order(2, status="F") + (ts(1),),
                                 order(3, status="F") + (ts(1),), order(4) + (ts(1),)], STAGING_SCHEMA)
    m = changes.merge(tgt, src, KEY, newer_than="last_modified", strategy=strategy)
    got = {k: v["o_orderstatus"] for k, v in by_key(m.result).items()}
    assert got == {1: "F", 2: "O", 3: "F", 4: "O"}
    classes = {r["o_orderkey"]: r["match_class"] for r in m.classes.collect()}
    assert classes == {1: "update", 2: "stale", 3: "update", 4: "insert"}
    assert m.metrics().first().asDict() == {"num_affected_rows": 3, "num_updated_rows": 2,
                                            "num_deleted_rows": 0, "num_inserted_rows": 1}


@pytest.mark.parametrize("strategy", ["broadcast", "shuffle"])
def test_merge_delete_missing(spark, target, strategy):
    src = orders_df(spark, [order(2, status="F"), order(9)])
    m = changes.merge(target, src, KEY, delete_missing=True, strategy=strategy)
    assert {k: v["o_orderstatus"] for k, v in by_key(m.result).items()} == {2: "F", 9: "O"}
    assert m.metrics().first().asDict() == {"num_affected_rows": 4, "num_updated_rows": 1,
                                            "num_deleted_rows": 2, "num_inserted_rows": 1}


@pytest.mark.parametrize("strategy", ["broadcast", "shuffle"])
def test_merge_pin_gives_same_result_and_classes_read_only_the_pin(spark, target, strategy):
    from tidesync.plans.publish import materialize
    from tidesync.session import scratch_path
    src = orders_df(spark, [order(2, status="F"), order(9)])
    pinned = []

    def pin(df):
        out = materialize(df, scratch_path(spark, "t-pin"))
        pinned.append(out)
        return out

    plain = changes.merge(target, src, KEY, strategy=strategy)
    m = changes.merge(target, src, KEY, strategy=strategy, pin=pin)
    assert len(pinned) == 1
    assert sorted(map(tuple, m.result.collect())) == sorted(map(tuple, plain.result.collect()))
    assert sorted(map(tuple, m.classes.collect())) == [(2, "update"), (9, "insert")]
    assert m.metrics().first()["num_affected_rows"] == 2
    # the classes come from the written match set alone: no scan of the target or the source
    files = m.classes.inputFiles()
    assert files and all("/t-pin-" in f for f in files)


@pytest.mark.parametrize("strategy", ["broadcast", "shuffle"])
@pytest.mark.parametrize("option", ["plain", "newer_than", "delete_missing"])
def test_merge_observed_metrics_equal_class_metrics(spark, strategy, option):
    stamp = F.lit(AS_OF).cast("timestamp")
    tgt = orders_df(spark, [order(1), order(2), order(3), order(4)]).withColumn("last_modified", stamp)
    src = orders_df(spark, [order(2, status="F"), order(3, status="F"), order(8)]).withColumn(
        "last_modified", F.when(F.col("o_orderkey") == 3, stamp - F.expr("INTERVAL 1 DAY"))
        .otherwise(stamp + F.expr("INTERVAL 1 DAY")))
    kw = {"newer_than": {"newer_than": "last_modified"}, "delete_missing": {"delete_missing": True}, "plain": {}}[option]
    m = changes.merge(tgt, src, KEY, strategy=strategy, observe=True, **kw)
    m.result.write.format("noop").mode("overwrite").save()
    assert m.observed_metrics() == m.metrics().first().asDict()


@pytest.mark.parametrize("strategy", ["broadcast", "shuffle"])
@pytest.mark.parametrize("case", ["all_matched", "all_new", "delete_all_matched"])
def test_merge_observed_metrics_when_a_branch_is_empty(spark, target, strategy, case):
    keys = {"all_matched": [1, 2], "all_new": [7, 8], "delete_all_matched": [1, 2, 3]}[case]
    src = orders_df(spark, [order(k, status="F") for k in keys])
    m = changes.merge(target, src, KEY, strategy=strategy, observe=True,
                      delete_missing=case == "delete_all_matched")
    m.result.write.format("noop").mode("overwrite").save()
    assert m.observed_metrics() == m.metrics().first().asDict()


@pytest.mark.parametrize("strategy", ["broadcast", "shuffle"])
def test_merge_observed_metrics_into_an_empty_target(spark, strategy):
    m = changes.merge(orders_df(spark, []), orders_df(spark, [order(5), order(6)]), KEY,
                      strategy=strategy, observe=True)
    m.result.write.format("noop").mode("overwrite").save()
    assert m.observed_metrics() == {"num_affected_rows": 2, "num_updated_rows": 0,
                                    "num_deleted_rows": 0, "num_inserted_rows": 2}
