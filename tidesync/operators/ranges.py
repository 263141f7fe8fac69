"""Key ranges: a table cut into ranges of its key by bounds taken from a bounded sample.

The ranges are by the first key column; equal values of it are never parted. Range 0 holds values below
the first bound and NULL keys. Bounds are kept as text (so they can be stored) and compared in the key's
own type, so no result depends on the session's time zone or on how a value is written.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys that are looked at to choose bounds, at most; the choice decides sizes only, never results.
SAMPLE_KEYS = 20_000


def range_value(column: str, dtype: T.DataType) -> tuple[Column, T.DataType]:
    """What is compared with the bounds: the key column, or a timestamp's microseconds."""
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(F.col(column)), T.LongType()
    return F.col(column), dtype


def key_bounds(df: DataFrame, key: Sequence[str], n: int) -> list[str]:
    """At most ``n - 1`` bounds that cut the keys of ``df`` into about equal ranges.

    The sample is the SAMPLE_KEYS rows with the smallest key hash, the same choice in every run. A top-k sends
    its first rows from every task to the driver, so the hash is cut first: about twice that many rows pass,
    whatever the number of rows and tasks; if too few do, as where keys repeat, the cut is raised.
    """
    value, dtype = range_value(key[0], df.schema[key[0]].dataType)
    keyed = (
        df.where(F.col(key[0]).isNotNull())
        .select(value.alias("v"), value.cast("string").alias("t"), F.xxhash64(*key).alias("h"))
    )
    total, found = keyed.count(), []
    share = min(1.0, 2 * SAMPLE_KEYS / max(1, total))
    while True:
        # only hashes below the cut go on, equal keys as one row with their count
        cut = int(-(2**63) + share * 2**64) - 1 if share < 1 else 2**63 - 1
        near = keyed.where(F.col("h") <= F.lit(cut)).groupBy("h", "v", "t").agg(F.count(F.lit(1)).alias("n"))
        found = near.orderBy("h", "v").limit(SAMPLE_KEYS).collect()
        if share >= 1 or sum(r["n"] for r in found) >= SAMPLE_KEYS:
            break
        share = min(1.0, 4 * share)
    rows, left = [], SAMPLE_KEYS
    for r in found:
        rows += [r] * min(left, r["n"])
        left -= min(left, r["n"])
    text = {r["v"]: r["t"] for r in rows}
    values = sorted(r["v"] for r in rows)
    cuts = sorted({values[len(values) * i // n] for i in range(1, n)}) if values else []
    return [text[v] for v in cuts if v != values[0]]


def _bounds(column: str, dtype: T.DataType, bounds: Sequence[str]) -> tuple[Column, list[Column]]:
    value, kind = range_value(column, dtype)
    return value, [F.lit(b).cast(kind) for b in bounds]


def range_of(column: str, dtype: T.DataType, bounds: Sequence[str]) -> Column:
    """Number of the range: how many bounds are at or below the value; 0 for NULL."""
    value, cuts = _bounds(column, dtype, bounds)
    number = F.lit(0)
    for c in cuts:
        number = number + F.when(value >= c, 1).otherwise(0)
    return number.cast("int")


def in_ranges(column: str, dtype: T.DataType, bounds: Sequence[str], ranges: Iterable[int]) -> Column:
    """Predicate for the rows of some ranges, as comparisons with the key (they reach the Parquet scan)."""
    value, cuts = _bounds(column, dtype, bounds)
    wanted = sorted(set(ranges))
    if not wanted:
        return F.lit(False)
    if len(wanted) == len(cuts) + 1:
        return F.lit(True)
    runs: list[list[int]] = []
    for r in wanted:                                       # neighbouring ranges become one interval
        if runs and runs[-1][1] == r - 1:
            runs[-1][1] = r
        else:
            runs.append([r, r])
    parts = []
    for first, last in runs:
        part = None
        if first > 0:
            part = value >= cuts[first - 1]
        if last < len(cuts):
            upper = value < cuts[last]
            part = upper if part is None else part & upper
        part = F.lit(True) if part is None else part
        parts.append(part | value.isNull() if first == 0 else part)
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out
