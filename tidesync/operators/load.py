"""Typed load under a contract, and the accepted / rejected split of untrusted rows.

Replaces building Python rows on the driver: every step is a column expression evaluated on the
executors (casts, ``try_cast``, ``nullif``, ``char_length``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidesync.contracts import TableContract
from tidesync.functions.values import contract_column, empty_to_null


def typed(df: DataFrame, contract: TableContract, keep: tuple[str, ...] = ()) -> DataFrame:
    """Project ``df`` onto the contract: its columns, in its order, cast to its types.

    Integers are cast null-safely, an empty status becomes NULL, price goes to DECIMAL(15,2) and
    dates to DATE. Columns the contract lacks (e.g. a staging stamp) are dropped, but for those named by ``keep``.
    """
    return df.select(*[contract_column(F.col(c), c, contract) for c in contract.columns], *keep)


MISSING_KEY, MISSING_FIELD, BAD_TYPE, TOO_LONG = "missing_key", "missing_field", "bad_type", "too_long"


def reject_reason(df: DataFrame, contract: TableContract, required: tuple[str, ...] = ()) -> Column:
    """First failed rule of a row, or NULL: missing key, missing required field, bad type, too long."""
    checks: list[Column] = []
    for k in contract.key:
        checks.append(F.when(F.col(k).isNull() | (F.col(k).cast("string") == ""), F.lit(f"{MISSING_KEY}:{k}")))
    for c in required:
        if c not in contract.key:
            checks.append(F.when(F.col(c).isNull(), F.lit(f"{MISSING_FIELD}:{c}")))
    for c in contract.columns:
        if c not in df.columns:
            continue
        dtype = contract.type_of(c)
        if isinstance(dtype, T.StringType):
            continue
        raw = F.col(c)
        if c in contract.empty_as_null:
            raw = empty_to_null(raw.cast("string"))
        checks.append(F.when(raw.isNotNull() & raw.try_cast(dtype).isNull(), F.lit(f"{BAD_TYPE}:{c}")))
    for c, n in contract.lengths.items():
        if c in df.columns:
            checks.append(F.when(F.char_length(F.col(c).cast("string")) > n, F.lit(f"{TOO_LONG}:{c}")))
    return F.coalesce(*checks) if checks else F.lit(None).cast("string")


@dataclass
class Split:
    accepted: DataFrame      # typed rows under the contract
    rejected: DataFrame      # raw rows plus ``reason``

    def reject_counts(self) -> DataFrame:
        return self.rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"))


def validate(df: DataFrame, contract: TableContract, required: tuple[str, ...] = (), keep_empty: bool = False) -> Split:
    """Split raw rows into typed accepted rows and rejected rows with the first failed rule.

    ``required`` lists fields that must be present (e.g. every field of a new-order record).
    ``keep_empty`` leaves ``''`` as it is; the default makes it NULL where the contract says so.

    Both outputs derive from one tagged projection; write them in one job with ``cache`` or a
    checkpoint upstream when the input is expensive to read twice.
    """
    missing = [c for c in contract.key if c not in df.columns]
    if missing:
        raise ValueError(f"input lacks key columns {missing}")
    tagged = df.withColumn("reason", reject_reason(df, contract, tuple(required)))
    accepted = tagged.where(F.col("reason").isNull()).select(
        *[contract_column(F.col(c), c, contract, checked=True, keep_empty=keep_empty) if c in df.columns
          else F.lit(None).cast(contract.type_of(c)).alias(c) for c in contract.columns])
    rejected = tagged.where(F.col("reason").isNotNull())
    return Split(accepted, rejected)
