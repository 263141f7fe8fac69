"""Typed load, ingest split, contract checks, defaults."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from helpers import order, orders_df
from tidesync.contracts import ORDERS, TPCH_KEYS
from tidesync.functions.values import with_defaults
from tidesync.operators import checks, load
from tidesync.sources import ingest, tables

SF = "/root/testdata/sf0.001"

TEXT = "o_orderkey string, o_custkey string, o_orderstatus string, o_totalprice string, o_orderdate string, " \
       "o_orderpriority string, o_clerk string, o_shippriority string, o_comment string"


def test_typed_casts_and_empty_status(spark):
    raw = spark.createDataFrame([("1", "5", "", "12.345", "1996-01-02", "1-URGENT", "c", "3", "x"),
                                 ("2", None, "F", "7", "1996-01-03", "2-HIGH", "c", None, "y")], TEXT)
    got = {r["o_orderkey"]: r for r in load.typed(raw, ORDERS).collect()}
    assert got[1]["o_orderstatus"] is None                       # '' -> NULL
    assert got[1]["o_totalprice"] == Decimal("12.35")            # scale 2
    assert got[1]["o_orderdate"] == dt.date(1996, 1, 2)
    assert got[2]["o_custkey"] is None and got[2]["o_shippriority"] is None


def test_validate_split_reasons(spark):
    raw = spark.createDataFrame([
        ("1", "5", "O", "1.00", "1996-01-02", "1-URGENT", "c", "0", "ok"),
        (None, "5", "O", "1.00", "1996-01-02", "1-URGENT", "c", "0", "no key"),
        ("3", "5", "O", "abc", "1996-01-02", "1-URGENT", "c", "0", "bad price"),
        ("4", "5", "O", "99999999999999999.00", "1996-01-02", "1-URGENT", "c", "0", "price overflow"),
        ("5", "5", "OO", "1.00", "1996-01-02", "1-URGENT", "c", "0", "long status"),
        ("6", "5", "O", "1.00", "1996-01-02", "1-URGENT", "c", "0", "x" * 80),
        ("7", "5", "", "1.00", "not a date", "1-URGENT", "c", "0", "bad date"),
    ], TEXT)
    split = load.validate(raw, ORDERS)
    assert [r["o_orderkey"] for r in split.accepted.collect()] == [1]
    reasons = {r["o_comment"]: r["reason"] for r in split.rejected.collect()}
    assert reasons["no key"] == "missing_key:o_orderkey"
    assert reasons["bad price"] == "bad_type:o_totalprice"
    assert reasons["price overflow"] == "bad_type:o_totalprice"
    assert reasons["long status"] == "too_long:o_orderstatus"
    assert reasons["x" * 80] == "too_long:o_comment"
    assert reasons["bad date"] == "bad_type:o_orderdate"
    counts = {r["reason"]: r["n_rows"] for r in split.reject_counts().collect()}
    assert sum(counts.values()) == 6


def test_json_ingest(spark):
    recs = spark.createDataFrame([
        ('{"o_orderkey": 1, "o_custkey": 2, "o_orderstatus": "O", "o_totalprice": 10.5, "o_orderdate": "1996-01-02",'
         ' "o_orderpriority": "1-URGENT", "o_clerk": "c", "o_shippriority": 0, "o_comment": "hi"}',),
        ('{"o_custkey": 2, "o_totalprice": 10.5}',),
        ('not json',),
    ], "value string")
    split = ingest.parse_records(recs, ORDERS)
    acc = split.accepted.collect()
    assert len(acc) == 1 and acc[0]["o_totalprice"] == Decimal("10.50")
    assert split.rejected.count() == 2


def test_key_violations_composite(spark):
    li = tables.read_table(spark, SF, "lineitem")
    v = checks.key_violations(li, TPCH_KEYS["lineitem"])
    n_keys = li.select("l_orderkey", "l_linenumber").distinct().count()
    assert li.count() == n_keys + v.agg(F.sum(F.col("n_rows") - 1)).first()[0]
    summary = checks.key_summary(li, TPCH_KEYS["lineitem"], "lineitem").first()
    assert summary["n_keys"] == n_keys and summary["n_repeated_keys"] == v.count()


def test_length_violations(spark):
    df = orders_df(spark, [order(1, status="OO"), order(2, comment="y" * 80), order(3)])
    got = {r["column_name"]: (r["max_length"], r["n_violations"]) for r in checks.length_violations(df, ORDERS).collect()}
    assert got == {"o_orderstatus": (1, 1), "o_orderpriority": (15, 0), "o_clerk": (15, 0), "o_comment": (79, 1)}


def test_defaults(spark):
    df = orders_df(spark, [order(1, status=None, prio=None, clerk=None, ship=None, date=None), order(2, status="F")])
    got = {r["o_orderkey"]: r for r in
           with_defaults(df, ORDERS, {"o_orderdate": F.lit("2024-06-30").cast("date")}).collect()}
    assert (got[1]["o_orderstatus"], got[1]["o_orderpriority"], got[1]["o_clerk"], got[1]["o_shippriority"]) == \
        ("O", "3-MEDIUM", "Clerk#000000001", 0)
    assert got[1]["o_orderdate"] == dt.date(2024, 6, 30)
    assert got[2]["o_orderstatus"] == "F"


def test_contract_ddl():
    ddl = ORDERS.ddl()
    assert "o_orderkey bigint NOT NULL" in ddl and "o_orderstatus char(1)" in ddl and "o_comment varchar(79)" in ddl
