"""The contract-aware entry points."""

import datetime as dt

from helpers import STAGING_SCHEMA, order, orders_df, patch_df
from tidesync import api
from tidesync.contracts import ORDER_CREATE_REQUIRED, ORDERS
from tidesync.sources import ingest

AS_OF = dt.datetime(2024, 6, 30, 12, 0, 0)


def staging(spark):
    return spark.createDataFrame([order(1) + (None,), order(2, comment="urgent thing") + (None,)], STAGING_SCHEMA)


def test_crud_round_trip(spark):
    st = staging(spark)
    ins = api.insert_strict(st, orders_df(spark, [order(3), order(1)]), as_of=AS_OF)
    assert [r["o_orderkey"] for r in ins.inserted.collect()] == [3]
    assert ins.inserted.first()["last_modified"] == AS_OF
    assert [(c["o_orderkey"], c["reason"]) for c in ins.conflicts.collect()] == [(1, "exists")]
    pat = api.patch_update(ins.result, patch_df(spark, [(3, None, "F", None, None, None, None, None, None)]),
                           as_of=AS_OF)
    assert {r["o_orderkey"]: r["o_orderstatus"] for r in pat.result.collect()}[3] == "F"
    rows, missing = api.get_by_keys(pat.result, spark.createDataFrame([(3,), (9,)], "o_orderkey long"))
    assert [r["o_orderkey"] for r in rows.collect()] == [3] and [r["o_orderkey"] for r in missing.collect()] == [9]
    gone = api.delete_by_keys(pat.result, spark.createDataFrame([(3,)], "o_orderkey long"))
    assert sorted(r["o_orderkey"] for r in gone.result.collect()) == [1, 2]
    assert api.search_count(gone.result, "URGENT").first()["count"] == 1
    assert [r["o_orderkey"] for r in api.search_page(gone.result, "", 1, 1).collect()] == [2]


def test_seed_stamps_with_now(spark):
    st = staging(spark)
    r = api.insert_if_absent(st, orders_df(spark, [order(1), order(5)]))
    new = r.new_rows.collect()
    assert [x["o_orderkey"] for x in new] == [5] and new[0]["last_modified"] is not None


def test_required_fields_of_new_order(spark):
    recs = spark.createDataFrame([
        ('{"o_orderkey": 1, "o_custkey": 2, "o_orderstatus": "O", "o_totalprice": 1, "o_orderdate": "1996-01-02",'
         ' "o_orderpriority": "1-URGENT", "o_clerk": "c", "o_shippriority": 0, "o_comment": "x"}',),
        ('{"o_orderkey": 2, "o_custkey": 2, "o_orderstatus": "O", "o_totalprice": 1, "o_orderdate": "1996-01-02",'
         ' "o_orderpriority": "1-URGENT", "o_shippriority": 0, "o_comment": "x"}',),
    ], "value string")
    split = ingest.parse_records(recs, ORDERS, required=ORDER_CREATE_REQUIRED)
    assert [r["o_orderkey"] for r in split.accepted.collect()] == [1]
    assert [r["reason"] for r in split.rejected.collect()] == ["missing_field:o_clerk"]


def test_forward_merge_picks_the_table_layout(spark):
    import uuid
    from tidesync.plans import bucketed, publish
    from tidesync.session import scratch_path
    root = scratch_path(spark, "t-api-fwd")
    lake = orders_df(spark, [order(1), order(2), order(3)])
    staged = orders_df(spark, [order(2, status="F"), order(4)])
    plain, buck = "t_api_p_" + uuid.uuid4().hex[:8], "t_api_b_" + uuid.uuid4().hex[:8]
    publish.publish_swap(lake, plain, f"{root}/p")
    bucketed.create(spark, buck, lake, ["o_orderkey"], 4, f"{root}/b")
    runs = {n: api.forward_merge(spark, staged, n, f"{root}/{d}") for n, d in ((plain, "p"), (buck, "b"))}
    assert runs[plain].strategy in ("broadcast", "shuffle") and runs[buck].strategy == "buckets"
    want = [(1, "O"), (2, "F"), (3, "O"), (4, "O")]
    for n in (plain, buck):
        got = sorted((r["o_orderkey"], r["o_orderstatus"]) for r in spark.table(n).collect())
        assert got == want
        assert runs[n].metrics["num_updated_rows"] == 1 and runs[n].metrics["num_inserted_rows"] == 1
