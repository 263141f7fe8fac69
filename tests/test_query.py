"""Search, counts, pages and lookups."""

import pytest
from pyspark.errors import AnalysisException

from helpers import order, orders_df
from tidesync.operators import query
from tidesync.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [order(i, comment=c) for i, c in enumerate(
        ["50% off", "500 off", "a_b", "axb", "back\\slash", "UPPER case", "upper CASE", "none"])]
    return orders_df(spark, rows)


def keys(df):
    return sorted(r["o_orderkey"] for r in df.collect())


def test_wildcards_in_term_are_active(docs):
    assert keys(query.search(docs, "o_comment", "50%off")) == [0, 1]
    assert keys(query.search(docs, "o_comment", "a_b")) == [2, 3]


def test_literal_term(docs):
    assert keys(query.search(docs, "o_comment", "50%", literal=True)) == [0]
    assert keys(query.search(docs, "o_comment", "a_b", literal=True)) == [2]
    assert keys(query.search(docs, "o_comment", "k\\s", literal=True)) == [4]


def test_case_insensitive_and_empty_term(docs):
    assert keys(query.search(docs, "o_comment", "upper case")) == [5, 6]
    assert len(keys(query.search(docs, "o_comment", ""))) == 8
    assert query.count_rows(docs, "o_comment", "UPPER").first()["count"] == 2


def test_pages_concatenate_to_whole_table(spark):
    lake = tables.lake_orders(spark, SF)
    whole = [r["o_orderkey"] for r in lake.orderBy("o_orderkey").select("o_orderkey").collect()]
    got, off = [], 0
    while True:
        page = [r["o_orderkey"] for r in query.page(lake, "o_orderkey", ["o_orderkey"], 400, off).collect()]
        if not page:
            break
        got += page
        off += 400
    assert got == whole


def test_keyset_equals_offset_paging(spark):
    lake = tables.lake_orders(spark, SF)
    first = query.keyset_page(lake, "o_orderkey", None, 50).collect()
    second = query.keyset_page(lake, "o_orderkey", first[-1]["o_orderkey"], 50).collect()
    assert second == query.page(lake, "o_orderkey", None, 50, 50).collect()


def test_composite_keyset(spark):
    li = tables.read_table(spark, SF, "lineitem", ["l_orderkey", "l_linenumber"]).distinct()
    a = query.keyset_page(li, ["l_orderkey", "l_linenumber"], (10, 3), 20).collect()
    b = (li.where("l_orderkey > 10 or (l_orderkey = 10 and l_linenumber > 3)")
         .orderBy("l_orderkey", "l_linenumber").limit(20).collect())
    assert a == b


def test_offset_past_end_and_negative_limit(docs):
    assert query.page(docs, "o_orderkey", None, 10, 1000).count() == 0
    with pytest.raises((ValueError, AnalysisException)):
        query.page(docs, "o_orderkey", None, -1, 0)


def test_page_stats(spark, docs):
    s = query.page_stats(docs, limit=3, offset=6).first().asDict()
    assert s == {"total_rows": 8, "page_number": 3, "page_count": 3, "first_shown": 7, "last_shown": 8,
                 "has_previous": True, "has_next": False}
    e = query.page_stats(docs, limit=3, offset=0, text_col="o_comment", term="zzz").first().asDict()
    assert e["total_rows"] == 0 and e["page_count"] == 1 and e["has_next"] is False and e["has_previous"] is False


def test_point_lookup_pushed_to_scan(spark):
    lake = tables.read_table(spark, SF, "orders")
    df = query.get_by_key(lake, "o_orderkey", 7)
    assert df.count() == 1
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderkey,7)" in plan


def test_table_or_empty(spark):
    from tidesync.contracts import ORDERS
    df = tables.table_or_empty(spark, "no_such_table_here", ORDERS.schema)
    assert df.count() == 0 and df.columns == ORDERS.columns


@pytest.mark.parametrize("offset", [0, 7, 499, 1234, 1499, 1500, 5000])
def test_deep_page_equals_top_k(spark, offset):
    lake = tables.lake_orders(spark, SF)
    want = lake.orderBy("o_orderkey").offset(offset).limit(25).collect()
    assert query.deep_page(lake, "o_orderkey", 25, offset, max_rest=10, bins=4).collect() == want


def test_deep_page_with_gaps_and_repeats(spark):
    li = tables.read_table(spark, SF, "lineitem", ["l_orderkey", "l_linenumber"])
    keys = [r["l_orderkey"] for r in li.orderBy("l_orderkey").select("l_orderkey").collect()]
    for offset in (0, 333, 4000, len(keys) - 1):
        got = [r["l_orderkey"] for r in query.deep_page(li, "l_orderkey", 40, offset, max_rest=50, bins=8)
               .select("l_orderkey").collect()]
        assert got == keys[offset:offset + 40]


@pytest.mark.parametrize("keys", [
    [None] * 3 + list(range(20)),
    [0] + [2**60 + i for i in range(4000)],
    [-9 * 10**18, 9 * 10**18] + list(range(50)),
])
def test_deep_page_equals_page_for_odd_keys(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(4)
    for offset in (0, 1, 2, 4, len(keys) // 2, len(keys) - 3, len(keys) - 1, len(keys)):
        want = query.page(df, "k", None, 3, offset).collect()
        assert query.deep_page(df, "k", 3, offset, max_rest=2, bins=16).collect() == want


def test_page_has_no_size_switch(spark):
    df = spark.range(300_000).selectExpr("id", "-id AS v")
    assert [r["v"] for r in query.page(df, "id", ["id", "v"], 2, 250_000).collect()] == [-250_000, -250_001]

