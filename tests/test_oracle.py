"""Every registered query against its DuckDB twin (the driver's check, on the smallest data)."""

import decimal
import hashlib

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_ORACLE
from tidesync.oracle import oracle_sql
from tidesync.plans.queries import REGISTRY

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6g}"
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.sha1("\n".join(sorted("|".join(_norm(r[i]) for i in order) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_ORACLE}/{t}.parquet')")
    return con


def test_every_table_query_has_an_oracle():
    """Queries of the optional corpus part may lack one; they are tested in tests/llm."""
    assert set(REGISTRY) == set(oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_ORACLE)
    rows = [tuple(r) for r in df.collect()]
    rel = duck.sql(E.oracle_sql()[name])
    orows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(rows) == len(orows)
    assert _digest(df.columns, rows) == _digest(rel.columns, orows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["num_affected_rows", "num_updated_rows", "num_deleted_rows", "num_inserted_rows"]
    assert rows[0]["num_affected_rows"] == rows[0]["num_updated_rows"] + rows[0]["num_inserted_rows"]
