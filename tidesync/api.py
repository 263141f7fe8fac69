"""Contract-aware entry points, one per call of the row-at-a-time service they replace.

Each takes DataFrames and a table contract and returns DataFrames (the new table state, the
affected rows and per-key outcomes); nothing is written here. "Now" is an argument (``as_of``),
defaulting to ``current_timestamp()``. Outcome labels replace HTTP codes: ``not_found`` (404),
``exists`` / ``duplicate_in_batch`` (409), ``no_fields`` (400).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidesync.contracts import CUSTOMER_VIEW_COLUMNS, ORDERS, ORDERS_STAGING, STAMP_COLUMN, TableContract
from tidesync.operators import changes, query
from tidesync.operators.keys import KeyJoin
from tidesync.plans import bucketed, clone, forward
from tidesync.streaming import sync


def _stamp(contract: TableContract, target: DataFrame, as_of) -> tuple[str, Column] | None:
    if STAMP_COLUMN not in contract.columns or STAMP_COLUMN not in target.columns:
        return None
    value = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    return (STAMP_COLUMN, value)


def search_page(df: DataFrame, term: str = "", limit: int = 50, offset: int = 0,
                key: str = "o_orderkey", text_col: str = "o_comment") -> DataFrame:
    """List orders: optional case-insensitive comment search, ordered by key, one page."""
    return query.search_page(df, key, text_col, term, limit, offset)


def search_count(df: DataFrame, term: str = "", text_col: str = "o_comment") -> DataFrame:
    """Count orders under the optional search (one row, column ``count``)."""
    return query.count_rows(df, text_col, term, alias="count")


def get_by_keys(df: DataFrame, keys: DataFrame, contract: TableContract = ORDERS_STAGING) -> tuple[DataFrame, DataFrame]:
    """Rows for the requested keys, and the keys not found."""
    kj = KeyJoin(df, keys.select(*contract.key), contract.key)
    return kj.table_rows(), kj.missing_keys()


def insert_strict(target: DataFrame, batch: DataFrame, contract: TableContract = ORDERS_STAGING,
                  as_of=None) -> changes.InsertResult:
    """Create orders; an existing or repeated key is a conflict and nothing of it is written."""
    return changes.insert_strict(target, batch, contract.key, stamp=_stamp(contract, target, as_of))


def patch_update(target: DataFrame, patches: DataFrame, contract: TableContract = ORDERS_STAGING,
                 as_of=None, order_by: str | None = None) -> changes.PatchResult:
    """Update orders with the given (non-NULL) fields and stamp them."""
    return changes.patch_update(target, patches, contract.key, stamp=_stamp(contract, target, as_of),
                                order_by=order_by)


def delete_by_keys(target: DataFrame, keys: DataFrame, contract: TableContract = ORDERS_STAGING) -> changes.DeleteResult:
    return changes.delete_by_keys(target, keys, contract.key)


def insert_if_absent(target: DataFrame, candidates: DataFrame, contract: TableContract = ORDERS_STAGING,
                     as_of=None) -> changes.SeedResult:
    """Seed: insert candidates whose key is absent; returns ``seeded`` / ``attempted``."""
    return changes.insert_if_absent(target, candidates, contract.key, stamp=_stamp(contract, target, as_of))


def page(df: DataFrame, key: str | Sequence[str] = "c_custkey", columns: Sequence[str] | None = CUSTOMER_VIEW_COLUMNS,
         limit: int = 100, offset: int = 0) -> DataFrame:
    """One ordered page of a table (customers by default)."""
    return query.page(df, key, columns, limit, offset)


def forward_merge(spark: SparkSession, staging: DataFrame, target_table: str, root: str,
                  contract: TableContract = ORDERS, **kw) -> forward.ForwardRun:
    """Merge the whole staging table into the lake table and publish the new version.

    A key-bucketed lake table (``tidesync.plans.bucketed``) gets only its touched buckets
    rewritten; any other table gets a new version swapped in whole."""
    if bucketed.is_bucketed(spark, target_table):
        kw.pop("use_catalog_merge", None)                   # Parquet buckets: no catalog MERGE
        return forward.forward_merge_buckets(spark, staging, bucketed.open_table(spark, target_table, root),
                                             contract, **kw)
    return forward.forward_merge(spark, staging, target_table, root, contract, **kw)


def sync_table(feed: DataFrame, target_table: str, root: str, contract: TableContract, checkpoint: str, **kw):
    """Keep ``target_table`` in step with the change feed, keyed by the contract's key."""
    return sync.sync_table(feed, target_table, root, contract.key, checkpoint, **kw)


def clone_tables(spark: SparkSession, sources: dict[str, DataFrame], schema: str, location: str | None = None,
                 parallelism: int = 4) -> dict[str, bool]:
    """Snapshot-clone every source into ``schema`` where the table does not exist yet."""
    return clone.clone_tables(spark, sources, schema, location, parallelism)
