"""Contract checks that Spark does not enforce on Parquet tables: key uniqueness, NOT NULL keys,
text length limits. Each is one aggregate pass with a map-side partial step."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidesync.contracts import TableContract
from tidesync.operators.dedupe import duplicate_keys


def key_violations(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with the row count (``n_rows``)."""
    return duplicate_keys(df, key, "n_rows")


def key_summary(df: DataFrame, key: Sequence[str], table_name: str) -> DataFrame:
    """One row per table: rows, distinct keys, repeated keys, rows with a NULL key part."""
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    null_key = F.lit(False)
    for k in key:
        null_key = null_key | F.col(k).isNull()
    return per_key.agg(
        F.lit(table_name).alias("table_name"),
        F.coalesce(F.sum("__n"), F.lit(0)).cast("long").alias("n_rows"),
        F.count(F.lit(1)).alias("n_keys"),
        F.count(F.when(F.col("__n") > 1, 1)).alias("n_repeated_keys"),
        F.coalesce(F.sum(F.when(null_key, F.col("__n"))), F.lit(0)).cast("long").alias("n_null_key_rows"),
    )


def key_summaries(tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]]) -> DataFrame:
    out = None
    for name, df in tables.items():
        s = key_summary(df, keys[name], name)
        out = s if out is None else out.unionByName(s)
    return out


def length_violations(df: DataFrame, contract: TableContract) -> DataFrame:
    """Per limited text column: its limit and how many values exceed it."""
    cols = [c for c in contract.lengths if c in df.columns]
    counts = df.agg(*[F.count(F.when(F.char_length(F.col(c)) > contract.lengths[c], 1)).alias(c) for c in cols])
    limits = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(contract.lengths[c]))])
    return (counts.unpivot([], cols, "column_name", "n_violations")
            .select("column_name", F.element_at(limits, F.col("column_name")).alias("max_length"), "n_violations"))


def null_key_rows(df: DataFrame, key: Sequence[str]) -> DataFrame:
    cond = F.lit(False)
    for k in key:
        cond = cond | F.col(k).isNull()
    return df.where(cond)
