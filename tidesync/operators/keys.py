"""Key-set joins between a large keyed table and a batch of keys or rows.

All are equi-joins on the primary key. When the batch is small (checked), the plan never
shuffles or broadcasts the table: the table's keys are semi-joined against the broadcast batch
keys (at most |batch| matches), and every anti-join runs batch-against-matches, both small.
Anti-joining the batch against the table directly would make Spark build a hash table of the
table itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidesync.operators.sizing import Size, fits_broadcast, hinted, key_size, measure


def without_keys(df: DataFrame, keys: DataFrame, key: Sequence[str], small: bool) -> DataFrame:
    """Rows of ``df`` whose key is not in ``keys`` (keys must be unique).

    Written as a left outer join plus ``IS NULL`` filter rather than a left anti join: Catalyst
    pushes an anti join into every branch of a Union in ``df``, which would compute ``keys`` (a
    scan of the target) once per branch; the outer join is not pushed.
    """
    key = list(key)
    flag = "__kj_matched"
    marked = keys.select(*key).withColumn(flag, F.lit(True))
    return df.join(hinted(marked, small), key, "left").where(F.col(flag).isNull()).drop(flag)


class KeyJoin:
    """Matches between ``table`` and a batch, computed once and reused by the DML operators."""

    def __init__(self, table: DataFrame, batch: DataFrame, key: Sequence[str], batch_size: Size | None = None):
        self.table = table
        self.batch = batch
        self.key = list(key)
        spark = batch.sparkSession
        self.batch_size = batch_size if batch_size is not None else measure(batch.select(*self.key))
        self.small = fits_broadcast(spark, key_size(self.batch_size, len(self.key)))

    def batch_keys(self) -> DataFrame:
        return self.batch.select(*self.key)

    def present(self) -> DataFrame:
        """Keys of the batch that exist in the table (bounded by the batch size)."""
        return self.table.select(*self.key).join(hinted(self.batch_keys(), self.small), self.key, "left_semi")

    def flagged_present(self, flag: str = "__present") -> DataFrame:
        return self.present().withColumn(flag, F.lit(True))

    def absent_rows(self, rows: DataFrame | None = None) -> DataFrame:
        """Batch rows whose key is not in the table (``ON CONFLICT DO NOTHING`` selection)."""
        rows = self.batch if rows is None else rows
        return without_keys(rows, self.present(), self.key, self.small)

    def missing_keys(self) -> DataFrame:
        """Requested keys not found in the table (the not-found outcome)."""
        return without_keys(self.batch_keys(), self.present(), self.key, self.small)

    def table_rows(self) -> DataFrame:
        """Rows of the table whose key is in the batch (point/batch lookup)."""
        return self.table.join(hinted(self.batch_keys(), self.small), self.key, "left_semi")

    def table_without(self) -> DataFrame:
        """The table minus the batch keys (delete)."""
        return self.table.join(hinted(self.batch_keys(), self.small), self.key, "left_anti")


def get_by_keys(table: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    return KeyJoin(table, keys, key).table_rows()


def missing_keys(table: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    return KeyJoin(table, keys, key).missing_keys()
