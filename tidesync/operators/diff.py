"""Changes between two snapshots of a keyed table, found by digests of key ranges and rows.

One pass over each snapshot gives a digest per key range (a few numbers per range, whatever the table's
size). Only ranges whose digests differ are read again, by key predicates that reach the scan, and their
rows are matched by key and compared by row digest. Equal ranges move nothing. Digests of a snapshot can be
kept and passed in, so that an unchanged snapshot is not read for them again.

A row's digest is two 64-bit hashes over all columns (with a flag per NULL, which Spark's hashes skip). A
range's digest is the number of its rows and the sums of both hashes, so row order does not matter.
Keys must be unique in each snapshot; NULL keys are matched with NULL keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidesync.operators.ranges import in_ranges, key_bounds, range_of

INSERTED, UPDATED, DELETED = "I", "U", "D"
CHANGE = "change"


def row_digest(columns: Sequence[str], salt: int) -> Column:
    flags = [F.col(c).isNull() for c in columns]
    return F.xxhash64(F.lit(salt), *flags, *[F.col(c) for c in columns])


def range_digests(df: DataFrame, key: Sequence[str], bounds: Sequence[str]) -> DataFrame:
    """(range, n_rows, sum_a, sum_b): at most one row per range; sums of 64-bit hashes as decimals."""
    columns = sorted(df.columns)
    of = range_of(key[0], df.schema[key[0]].dataType, bounds)
    wide = "decimal(20,0)"
    return df.groupBy(of.alias("range")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(row_digest(columns, 1).cast(wide)).alias("sum_a"),
        F.sum(row_digest(columns, 2).cast(wide)).alias("sum_b"),
    )


def differing_ranges(old: DataFrame, new: DataFrame) -> list[int]:
    """Ranges whose digests differ (``old``, ``new``: results of ``range_digests``; few small rows)."""
    a, b = ({r["range"]: tuple(r)[1:] for r in d.select("range", "n_rows", "sum_a", "sum_b").collect()} for d in (old, new))
    return sorted(r for r in a.keys() | b.keys() if a.get(r) != b.get(r))


def snapshot_changes(old: DataFrame, new: DataFrame, key: Sequence[str], *, ranges: int = 64,
                     bounds: Sequence[str] | None = None, old_digests: DataFrame | None = None) -> DataFrame:
    """Rows that differ: the columns of ``new`` and ``change`` ('I', 'U' or 'D').

    Inserted and updated rows carry the new values, deleted ones the key and NULLs. ``old_digests``
    (with the ``bounds`` they were made for) saves the digest pass over ``old``.
    """
    key = list(key)
    if sorted(old.columns) != sorted(new.columns):
        raise ValueError(f"the snapshots have different columns: {sorted(set(old.columns) ^ set(new.columns))}")
    if old_digests is not None and bounds is None:
        raise ValueError("kept digests need the bounds they were made for")
    bounds = key_bounds(old, key, ranges) if bounds is None else bounds
    before = old_digests if old_digests is not None else range_digests(old, key, bounds)
    differ = differing_ranges(before, range_digests(new, key, bounds))
    columns = sorted(old.columns)
    values = [c for c in new.columns if c not in key]

    def part(df: DataFrame) -> DataFrame:
        return df.where(in_ranges(key[0], df.schema[key[0]].dataType, bounds, differ))

    here = [F.col(k).alias(f"__o{i}") for i, k in enumerate(key)]
    left = part(old).select(*here, row_digest(columns, 1).alias("__oa"), row_digest(columns, 2).alias("__ob"), F.lit(True).alias("__old"))
    right = part(new).withColumns({"__na": row_digest(columns, 1), "__nb": row_digest(columns, 2), "__new": F.lit(True)})
    match = F.lit(True)
    for i, k in enumerate(key):
        match = match & F.col(f"__o{i}").eqNullSafe(F.col(k))
    both = left.join(right, match, "full_outer")
    change = (
        F.when(F.col("__old").isNull(), F.lit(INSERTED))
        .when(F.col("__new").isNull(), F.lit(DELETED))
        .when((F.col("__oa") != F.col("__na")) | (F.col("__ob") != F.col("__nb")), F.lit(UPDATED))
    )
    keys = [F.when(F.col("__new"), F.col(k)).otherwise(F.col(f"__o{i}")).alias(k) for i, k in enumerate(key)]
    out = both.withColumn(CHANGE, change).where(F.col(CHANGE).isNotNull())
    return out.select(*keys, *values, CHANGE).select(*new.columns, CHANGE)
