"""The forward job: staged rows → contract types → checks → MERGE into the lake table → publish.

Run it from any scheduler (e.g. every 15 minutes); each run reads the whole staging table once,
so a second run of the same staging leaves the target as it is (MERGE is idempotent).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidesync.contracts import ORDERS, TableContract
from tidesync.operators.changes import merge, prepare_source
from tidesync.operators.dedupe import DuplicateKeyError
from tidesync.operators.load import reject_reason, typed
from tidesync.operators.sizing import Size, measure, measure_keyed
from tidesync.plans import bucketed
from tidesync.plans.publish import mark_owner, materialize, publish_swap, refuse_partitioned


@dataclass
class ForwardRun:
    status: str                  # 'merged' or 'no_rows'
    metrics: dict | None = None
    path: str | None = None
    strategy: str | None = None
    rejects: str | None = None   # folder of the rows that broke the contract, with ``reason``


def merge_into_catalog(spark: SparkSession, source: DataFrame, target_table: str,
                       contract: TableContract = ORDERS) -> bool:
    """``MERGE INTO`` through the catalog when the table format supports it (Delta, Iceberg, ...):
    matched → update all columns, not matched → insert. Returns False when the table's format has
    no MERGE (plain Parquet), so the caller falls back to the join plan and a location swap."""
    cond = " AND ".join(f"t.{k} = s.{k}" for k in contract.key)
    try:
        (source.alias("s").mergeInto(target_table, F.expr(cond.replace("t.", f"{target_table}.")))
         .whenMatched().updateAll().whenNotMatched().insertAll().merge())
        return True
    except PySparkException as e:
        if (e.getCondition() or "").startswith("UNSUPPORTED_FEATURE"):
            return False
        raise


REASON = "reason"


@dataclass
class Staged:
    source: DataFrame            # accepted rows to merge, one per key
    size: Size | None            # None: no accepted row
    fetched: int                 # rows read from the staging
    rejected: int
    rejects: str | None          # folder of the rejected rows; None: no such row
    snapshot: DataFrame          # all rows read, with ``reason`` and the columns named by ``keep``


def staged_source(staging: DataFrame, table: str, root: str, contract: TableContract,
                  on_duplicate: str, order_by: Sequence[str], keep: Sequence[str] = ()) -> Staged:
    """The staging under the contract types, read once into a snapshot below ``root``. Rows with a
    NULL key or over-long text go to a rejects folder with their reason, so they never reach the
    target; the others are measured and their keys checked by one aggregate. ``keep`` names further
    columns of the staging for the snapshot; they are not merged."""
    path = f"{root.rstrip('/')}/staging-{uuid.uuid4().hex[:12]}"
    rows = typed(staging, contract, keep)
    snapshot = materialize(rows.withColumn(REASON, reject_reason(rows, contract)), path)
    mark_owner(staging.sparkSession, path, table)
    bad = snapshot.where(F.col(REASON).isNotNull()).drop(*keep)
    source = snapshot.where(F.col(REASON).isNull()).drop(REASON, *keep)
    rejected, rejects = bad.count(), None
    if rejected:
        rejects = f"{root.rstrip('/')}/rejects-{uuid.uuid4().hex[:12]}"
        bad.write.parquet(rejects)
    size, top = measure_keyed(source, contract.key)
    fetched = size.rows + rejected
    if size.rows == 0:
        return Staged(source, None, fetched, rejected, rejects, snapshot)
    if top > 1:
        if on_duplicate == "error":
            raise DuplicateKeyError(f"staging repeats keys {list(contract.key)}; pass on_duplicate='latest'")
        source = prepare_source(source, contract.key, on_duplicate, order_by)
        size = measure(source)
    return Staged(source, size, fetched, rejected, rejects, snapshot)


def forward_merge(spark: SparkSession, staging: DataFrame, target_table: str, root: str,
                  contract: TableContract = ORDERS, on_duplicate: str = "error",
                  order_by: Sequence[str] = (), use_catalog_merge: bool = False) -> ForwardRun:
    """Merge the whole staging table into ``target_table`` and publish the new version.

    The staging is read once, into a snapshot below ``root``; the size check, the key check,
    the empty-batch check and the new state all read that snapshot. The metrics are counted
    while the new state is written (``merge(observe=True)``): no job and no target scan of
    their own. Snapshots are ordinary folders below ``root`` and are removed by
    ``tidesync.plans.retention.vacuum`` like old versions.

    ``use_catalog_merge=True`` first tries the table format's own MERGE (row-level rewrite of the
    touched files only); plain Parquet tables fall back to the join plan of ``merge``.
    """
    if not use_catalog_merge:
        refuse_partitioned(spark, target_table)
    staged = staged_source(staging, target_table, root, contract, on_duplicate, order_by)
    return merge_staged(spark, staged, target_table, root, contract, use_catalog_merge)


def merge_staged(spark: SparkSession, staged: Staged, target_table: str, root: str,
                 contract: TableContract = ORDERS, use_catalog_merge: bool = False) -> ForwardRun:
    """Merge rows already staged into ``target_table`` and publish the new version."""
    if staged.size is None:                                  # nothing to merge: no publish
        return ForwardRun("no_rows", rejects=staged.rejects)
    if use_catalog_merge and merge_into_catalog(spark, staged.source, target_table, contract):
        return ForwardRun("merged", None, None, "catalog", staged.rejects)
    target = spark.table(target_table)
    m = merge(target, staged.source, contract.key, on_duplicate="trust", source_size=staged.size, observe=True)
    path = publish_swap(m.result, target_table, root)
    counts = {"fetched_rows": staged.fetched, "rejected_rows": staged.rejected}
    return ForwardRun("merged", {**m.observed_metrics(), **counts}, path, m.strategy, staged.rejects)


def forward_merge_buckets(spark: SparkSession, staging: DataFrame, table: bucketed.BucketedTable,
                          contract: TableContract = ORDERS, on_duplicate: str = "error",
                          order_by: Sequence[str] = ()) -> ForwardRun:
    """The forward job on a key-bucketed lake table: only the buckets holding staged keys are
    read, merged and rewritten; the rest of the table is not touched."""
    staged = staged_source(staging, table.name, table.root, contract, on_duplicate, order_by)
    return merge_staged_buckets(spark, staged, table, contract)


def merge_staged_buckets(spark: SparkSession, staged: Staged, table: bucketed.BucketedTable,
                         contract: TableContract = ORDERS) -> ForwardRun:
    """Merge rows already staged into the buckets that hold their keys.

    The metrics are taken from committed files: a MERGE removes no row, so the buckets' new files hold as many rows
    more than the old ones as were inserted, and the other staged rows (one per key) are updates of the contract's
    unique key. A map stage that runs again after a lost executor cannot count twice, as an accumulator below
    the bucket exchange could."""
    if staged.size is None:
        return ForwardRun("no_rows", rejects=staged.rejects)
    key = list(contract.key)

    def change(current: DataFrame, changes: DataFrame) -> DataFrame:
        return merge(current, changes, key, on_duplicate="trust", source_size=staged.size).result

    before = bucketed.partition_locations(spark, table.name)
    touched = bucketed.apply(spark, table, staged.source, change)
    after = bucketed.partition_locations(spark, table.name)
    held, holds = (bucketed.count_files(spark, [at[b] for b in touched if b in at]) for at in (before, after))
    inserted = holds - held
    metrics = {"num_affected_rows": staged.size.rows, "num_updated_rows": staged.size.rows - inserted,
               "num_deleted_rows": 0, "num_inserted_rows": inserted}
    counts = {"touched_buckets": len(touched), "fetched_rows": staged.fetched, "rejected_rows": staged.rejected}
    return ForwardRun("merged", {**metrics, **counts}, table.root, "buckets", staged.rejects)
