"""Incremental forward run: reads what changed, equals the full run, survives lost runs."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from helpers import STAGING_SCHEMA, by_key, order, orders_df
from tidesync.operators.dedupe import DuplicateKeyError
from tidesync.plans import bucketed, forward, incremental, versions
from tidesync.plans.publish import publish_swap
from tidesync.session import scratch_path

T0 = dt.datetime(2024, 6, 30, 8, 0, 0)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def staged(spark, rows):
    """rows: (key, price, minutes or None)"""
    return spark.createDataFrame([(*order(k, price=p), None if m is None else at(m)) for k, p, m in rows], STAGING_SCHEMA)


@pytest.fixture
def job(spark):
    root = scratch_path(spark, "inc-test")
    name = "inc_" + root.rsplit("-", 1)[-1]
    publish_swap(orders_df(spark, [order(k, price="1.00") for k in range(1, 6)]), name, root)

    def run(rows, **options):
        return incremental.forward_incremental(spark, staged(spark, rows), name, root, **options)

    run.name, run.root = name, root
    return run


def prices(spark, name):
    return {k: str(r["o_totalprice"]) for k, r in by_key(spark.table(name)).items()}


def test_second_run_merges_only_changes(spark, job):
    first = [(1, "2.00", 0), (2, "2.00", 10), (9, "2.00", 20)]
    assert job(first).metrics["fetched_rows"] == 3
    run = job([(1, "2.00", 0), (2, "3.00", 30), (9, "2.00", 20), (10, "3.00", 31)])
    assert run.metrics["fetched_rows"] == 2 and run.metrics["late_rows"] == 0
    assert (run.metrics["num_updated_rows"], run.metrics["num_inserted_rows"]) == (1, 1)
    assert prices(spark, job.name) == {1: "2.00", 2: "3.00", 3: "1.00", 4: "1.00", 5: "1.00", 9: "2.00", 10: "3.00"}


def test_late_rows_inside_the_overlap_and_the_sweep(spark, job):
    job([(1, "2.00", 60)])
    run = job([(1, "2.00", 60), (2, "2.00", 50), (3, "2.00", 10)])
    assert run.metrics["fetched_rows"] == 1 and run.metrics["late_rows"] == 1     # key 3 is older than the overlap
    assert prices(spark, job.name)[3] == "1.00"
    run = job([(1, "2.00", 60), (2, "2.00", 50), (3, "2.00", 10)], sweep=True)
    assert run.metrics["fetched_rows"] == 3
    assert prices(spark, job.name)[3] == "2.00"
    assert job([(1, "2.00", 60), (2, "2.00", 50), (3, "2.00", 10)]).status == "no_rows"


def test_change_under_an_equal_stamp_and_rows_without_stamp(spark, job):
    job([(1, "2.00", 60), (2, "2.00", None)])
    run = job([(1, "4.00", 60), (2, "2.00", None), (3, "5.00", None)])
    assert run.metrics["fetched_rows"] == 2
    assert prices(spark, job.name)[1] == "4.00" and prices(spark, job.name)[3] == "5.00"
    assert job([(1, "4.00", 60), (2, "2.00", None), (3, "5.00", None)]).metrics["fetched_rows"] == 0
    far = job([(1, "4.00", 60), (2, "2.00", None), (3, "5.00", None), (4, "6.00", 600)])
    assert far.metrics["fetched_rows"] == 1                                       # unstamped digests are kept


def test_empty_and_unstamped_only(spark, job):
    assert job([]).status == "no_rows"
    assert versions.numbers(spark, f"{job.root}/progress") == []
    job([(1, "2.00", None)])
    assert incremental.progress(spark, f"{job.root}/progress").mark is None
    assert job([(1, "2.00", None)]).status == "no_rows"


def test_repeated_keys_publish_nothing(spark, job):
    before = prices(spark, job.name)
    with pytest.raises(DuplicateKeyError):
        job([(1, "2.00", 0), (1, "3.00", 1)])
    assert prices(spark, job.name) == before
    assert versions.numbers(spark, f"{job.root}/progress") == []


def test_rejected_rows_are_rejected_once(spark, job):
    bad = staged(spark, [(1, "2.00", 0)]).unionByName(
        staged(spark, [(2, "2.00", 1)]).withColumn("o_comment", F.repeat(F.lit("x"), F.lit(80))))
    runs = [incremental.forward_incremental(spark, bad, job.name, job.root) for _ in range(2)]
    assert [r.metrics["rejected_rows"] for r in runs] == [1, 0]
    assert spark.read.parquet(runs[0].rejects).columns == [*orders_df(spark, []).columns, "reason"]


def test_lost_between_target_and_record(spark, job, monkeypatch):
    rows = [(1, "2.00", 0), (9, "2.00", 5)]

    def lost(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(versions, "put", lost)
        with pytest.raises(RuntimeError, match="driver lost"):
            job(rows)
    run = job(rows)
    assert run.metrics["fetched_rows"] == 2 and run.metrics["num_updated_rows"] == 2
    assert prices(spark, job.name)[9] == "2.00" and spark.table(job.name).count() == 6


def test_equals_the_full_run_over_many_rounds(spark, job):
    full_root = scratch_path(spark, "inc-full")
    full = "inc_full_" + full_root.rsplit("-", 1)[-1]
    publish_swap(orders_df(spark, [order(k, price="1.00") for k in range(1, 6)]), full, full_root)
    state = {}
    for n in range(5):
        for k in range(1, 30):
            if (k * 7 + n * 5) % 6 == 0:
                state[k] = (k, f"{n + 1}.50", n * 10 + k % 10 - (9 if k % 4 == 0 else 0))
        job(list(state.values()))
        forward.forward_merge(spark, staged(spark, list(state.values())), full, full_root)
        assert prices(spark, job.name) == prices(spark, full)
    ledgers = [p for p in map(lambda n: versions.get(spark, f"{job.root}/progress", n)["ledger"],
                              versions.numbers(spark, f"{job.root}/progress"))]
    alive = [p for p in ledgers if versions.file_system(spark, p)[0].exists(versions.file_system(spark, p)[1])]
    assert alive == ledgers[-incremental.KEPT_RECORDS:]


def test_buckets_only_changed_ones(spark):
    root = scratch_path(spark, "inc-buckets")
    table = bucketed.create(spark, "inc_b_" + root.rsplit("-", 1)[-1],
                            orders_df(spark, [order(k, price="1.00") for k in range(200)]), ["o_orderkey"], 16, root)
    incremental.forward_incremental_buckets(spark, staged(spark, [(k, "2.00", 0) for k in range(100)]), table)
    rows = [(k, "2.00", 0) for k in range(100)] + [(150, "3.00", 5)]
    run = incremental.forward_incremental_buckets(spark, staged(spark, rows), table)
    assert run.metrics["touched_buckets"] == 1 and run.metrics["fetched_rows"] == 1
    got = by_key(table.read(spark))
    assert got[150]["o_totalprice"] == Decimal("3.00") and got[99]["o_totalprice"] == Decimal("2.00") and len(got) == 200


@pytest.mark.parametrize("stamp_type", ["timestamp", "timestamp_ntz"])
def test_mark_reaches_the_scan(spark, stamp_type):
    path = scratch_path(spark, "inc-scan")
    staged(spark, [(k, "2.00", k) for k in range(100)]).withColumn(
        "last_modified", F.col("last_modified").cast(stamp_type)).write.parquet(path)
    df = spark.read.parquet(path)
    low = df.select(incremental._micros("last_modified")).orderBy("last_modified").collect()[90][0]
    changed = incremental.changed_since(df, "last_modified", low)
    assert changed.count() == 10
    plan = changed._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(last_modified" in plan.split("PushedFilters")[1]


def test_a_time_zone_does_not_move_the_mark(spark, job):
    job([(1, "2.00", 0)])
    mark = incremental.progress(spark, f"{job.root}/progress").mark
    zone = spark.conf.get("spark.sql.session.timeZone")
    rows = staged(spark, [(1, "2.00", 0), (2, "2.00", 1)])
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        run = incremental.forward_incremental(spark, rows, job.name, job.root)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert run.metrics["fetched_rows"] == 1
    assert incremental.progress(spark, f"{job.root}/progress").mark == mark + 60_000_000


def test_missing_stamp_column(spark, job):
    with pytest.raises(ValueError, match="no stamp"):
        incremental.forward_incremental(spark, orders_df(spark, [order(1)]), job.name, job.root)
