"""Size checks that decide whether a side of a join may be broadcast.

A side is broadcast only behind a proven bound: either a measured one (one aggregate pass that
counts rows and sums an upper estimate of their in-memory size) or one inherited from a side
already measured (e.g. the keys of the target that match a measured batch are at most as many
as the batch rows). Beyond the limit the plain join is left to Catalyst and AQE, which shuffle
both sides on the key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidesync.functions.values import row_bytes

# Default broadcast limit for a measured side, in bytes of estimated in-memory rows.
DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024
CONF_BROADCAST_BYTES = "tidesync.broadcast.maxBytes"


@dataclass(frozen=True)
class Size:
    rows: int
    bytes: int

    def scaled_to(self, columns_fraction: float) -> "Size":
        return Size(self.rows, int(self.bytes * columns_fraction) + 1)


def broadcast_limit(spark: SparkSession) -> int:
    value = spark.conf.get(CONF_BROADCAST_BYTES, None)
    return int(value) if value else DEFAULT_BROADCAST_BYTES


def measure(df: DataFrame) -> Size:
    """Row count and estimated in-memory bytes of ``df`` in one aggregate job."""
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(row_bytes(df.schema)).alias("bytes")).first()
    return Size(int(row["rows"]), int(row["bytes"] or 0))


def measure_keyed(df: DataFrame, key) -> tuple[Size, int]:
    """Size of ``df`` and the largest number of rows sharing one key, in one aggregate job.

    The per-key partial aggregate runs map-side, so a hot key is reduced before the shuffle.
    """
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes(df.schema)).alias("b"))
    row = per_key.agg(F.sum("n").alias("rows"), F.sum("b").alias("bytes"), F.max("n").alias("top")).first()
    return Size(int(row["rows"] or 0), int(row["bytes"] or 0)), int(row["top"] or 0)


def key_size(size: Size, n_key_columns: int) -> Size:
    """Bound for a key-only projection of a measured side: never more than its measured bytes (text keys
    can be wide), plus the fixed part of a row."""
    return Size(size.rows, size.bytes + size.rows * (16 + 8 * n_key_columns))


def fits_broadcast(spark: SparkSession, size: Size | None) -> bool:
    return size is not None and size.bytes <= broadcast_limit(spark)


def hinted(df: DataFrame, small: bool) -> DataFrame:
    """Broadcast hint on a side whose bound was checked; otherwise leave the choice to AQE."""
    return F.broadcast(df) if small else df
