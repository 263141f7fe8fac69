"""Incremental forward run: only the staging rows modified since the last run are read and merged.

Every staging row carries a stamp set on insert and on each patch (``last_modified``). A run reads the
rows whose stamp is not below the high-water mark less an overlap, a predicate that reaches the scan
(Parquet row groups, or the ``WHERE`` clause of a JDBC read). The mark is the largest stamp a run has
seen, taken from the rows themselves, so no clock of the job enters.

A stamp is set when a transaction begins and the row is seen when it ends, so rows with a stamp below
the mark may still appear: the overlap is the longest time that may take. Rows of the overlap that an
earlier run has merged are told apart by a ledger: 128-bit digests over all columns of the rows with
stamps inside the overlap. Only rows that are not in it are merged, so a run's work is what changed, and a
row that changed twice under one stamp is still seen. Ledger and mark are published in one numbered
record after the target; a run lost in between is repeated over the same rows, and the MERGE is idempotent.
``sweep=True`` reads the whole staging (a full run) and starts a new ledger: for rows that came later than
the overlap allows, which no mark can find. ``late_rows`` of the metrics counts rows below the former mark.

The result equals a full run as long as nothing else writes the lake rows of unchanged staging rows: a full
run would overwrite them with the staging again, an incremental one leaves them.

Cases: the staging has one row per key (its primary key), else ``DuplicateKeyError`` and nothing is published.
Rows without a stamp are read by each run and merged when their digest is new, so their digests stay in the
ledger. Rejected rows are in the ledger too and rejected once. An empty staging, or one without changes, publishes
neither a table version nor a record. One run at a time per target; a second one that publishes the same
record number fails with ``ConflictError`` and its next run reads the same rows again.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidesync.contracts import ORDERS, STAMP_COLUMN, TableContract
from tidesync.plans import bucketed, versions
from tidesync.plans.forward import ForwardRun, Staged, merge_staged, merge_staged_buckets, staged_source

DEFAULT_OVERLAP = dt.timedelta(minutes=15)
DIGEST = ("__digest_1", "__digest_2")
_SEEDS = (11, 12)                 # Fixed values: tell the two hashes of a digest apart
KEPT_RECORDS = 2                  # ledgers of older records are deleted


@dataclass(frozen=True)
class Progress:
    mark: int | None = None       # microseconds since the epoch; None: no stamped row was seen yet
    ledger: str | None = None     # folder of the digests


def progress(spark: SparkSession, state: str) -> Progress:
    """What the last published run has seen; ``state`` is the folder of the run's records."""
    found = versions.latest(spark, state)
    return Progress(found[1]["mark"], found[1]["ledger"]) if found else Progress()


def _micros(stamp: str) -> Column:
    return F.unix_micros(F.col(stamp).cast("timestamp"))


def changed_since(staging: DataFrame, stamp: str, low: int | None) -> DataFrame:
    """Rows with no stamp or one of at least ``low`` (microseconds); all rows if ``low`` is None."""
    if low is None:
        return staging
    bound = F.timestamp_micros(F.lit(low)).cast(staging.schema[stamp].dataType)
    return staging.where(F.col(stamp).isNull() | (F.col(stamp) >= bound))


def with_digest(staging: DataFrame) -> DataFrame:
    """Two 64-bit hashes over all columns by name, each column's NULL told from every value."""
    names = sorted(staging.columns)
    parts = [p for c in names for p in (F.col(c).isNull(), F.col(c))]
    return staging.withColumns({d: F.xxhash64(F.lit(s), *parts) for d, s in zip(DIGEST, _SEEDS)})


def _fresh(spark: SparkSession, staging: DataFrame, stamp: str, seen: Progress, overlap: int, sweep: bool) -> DataFrame:
    low = None if sweep or seen.mark is None else seen.mark - overlap
    rows = with_digest(changed_since(staging, stamp, low))
    if sweep or seen.ledger is None:
        return rows
    return rows.join(spark.read.parquet(seen.ledger), list(DIGEST), "left_anti")


def _publish(spark: SparkSession, state: str, seen: Progress, staged: Staged, stamp: str, overlap: int, sweep: bool,
             mark: int | None) -> None:
    new = staged.snapshot.select(*DIGEST, _micros(stamp).alias("at"))
    if seen.ledger is not None and not sweep:
        new = spark.read.parquet(seen.ledger).unionByName(new)
    if mark is not None:
        new = new.where(F.col("at").isNull() | (F.col("at") >= mark - overlap))
    ledger = f"{state}/ledger-{uuid.uuid4().hex[:12]}"
    new.distinct().write.parquet(ledger)
    used = versions.numbers(spark, state)
    versions.put(spark, state, used[-1] + 1 if used else 1, {"mark": mark, "ledger": ledger})
    for n in used[:-(KEPT_RECORDS - 1)]:
        old = versions.get(spark, state, n)
        if old:
            fs, where = versions.file_system(spark, old["ledger"])
            fs.delete(where, True)


def _run(spark: SparkSession, staging: DataFrame, table: str, root: str, state: str, contract: TableContract,
         stamp: str, overlap: dt.timedelta, sweep: bool, apply: Callable[[Staged], ForwardRun]) -> ForwardRun:
    if stamp not in staging.columns:
        raise ValueError(f"staging has no stamp column {stamp!r}")
    width = overlap // dt.timedelta(microseconds=1)
    if width < 0:
        raise ValueError("overlap must not be negative")
    seen = progress(spark, state)
    rows = _fresh(spark, staging, stamp, seen, width, sweep)
    keep = tuple(c for c in (stamp, *DIGEST) if c not in contract.columns)
    staged = staged_source(rows, table, root, contract, "error", (), keep)
    low = F.lit(seen.mark).cast("long")
    row = staged.snapshot.agg(F.max(_micros(stamp)).alias("top"),
                              F.count(F.when(_micros(stamp) < low, 1)).alias("late")).first()
    run = apply(staged)
    if staged.fetched:
        mark = max((m for m in (seen.mark, row["top"]) if m is not None), default=None)
        _publish(spark, state, seen, staged, stamp, width, sweep, mark)
    counts = {"fetched_rows": staged.fetched, "rejected_rows": staged.rejected, "late_rows": row["late"]}
    run.metrics = {**(run.metrics or {}), **counts}
    return run


def forward_incremental(spark: SparkSession, staging: DataFrame, target_table: str, root: str,
                        contract: TableContract = ORDERS, stamp: str = STAMP_COLUMN,
                        overlap: dt.timedelta = DEFAULT_OVERLAP, sweep: bool = False) -> ForwardRun:
    """Merge the staging rows changed since the last run into ``target_table`` and publish the new version."""
    state = f"{root.rstrip('/')}/progress"
    return _run(spark, staging, target_table, root, state, contract, stamp, overlap, sweep,
                lambda staged: merge_staged(spark, staged, target_table, root, contract))


def forward_incremental_buckets(spark: SparkSession, staging: DataFrame, table: bucketed.BucketedTable,
                                contract: TableContract = ORDERS, stamp: str = STAMP_COLUMN,
                                overlap: dt.timedelta = DEFAULT_OVERLAP, sweep: bool = False) -> ForwardRun:
    """The same on a key-bucketed table: only buckets that hold changed keys are read and rewritten."""
    state = f"{table.root.rstrip('/')}/progress"
    return _run(spark, staging, table.name, table.root, state, contract, stamp, overlap, sweep,
                lambda staged: merge_staged_buckets(spark, staged, table, contract))
