"""Key uniqueness: find repeated keys and keep one row per key, skew-safe.

Both use hash aggregation with a map-side partial step, so a key that holds a third of all rows
is reduced to one row per input partition before the shuffle; no key is ever gathered whole into
one task, unlike a ``row_number`` window over the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class DuplicateKeyError(ValueError):
    pass


def duplicate_keys(df: DataFrame, key: Sequence[str], count_col: str = "n_rows") -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return (
        df.groupBy(*key)
        .agg(F.count(F.lit(1)).alias(count_col))
        .where(F.col(count_col) > 1)
    )


def has_duplicate_keys(df: DataFrame, key: Sequence[str]) -> bool:
    return not duplicate_keys(df, key).isEmpty()


def require_unique(df: DataFrame, key: Sequence[str], what: str = "source") -> None:
    if has_duplicate_keys(df, key):
        raise DuplicateKeyError(f"{what} repeats keys {list(key)}; pass on_duplicate='latest' with order_by")


def latest_per_key(df: DataFrame, key: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """One row per key: the row with the greatest ``order_by`` values, ties broken by all columns.

    Implemented as ``max(struct(order_by..., other columns...))`` per key: a total order, so the
    result does not depend on partitioning, and an aggregate with a partial step.
    """
    rest = [c for c in df.columns if c not in key and c not in order_by]
    packed = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order_by)],
                      *[F.col(c).alias(f"r{i}") for i, c in enumerate(rest)])
    best = df.groupBy(*key).agg(F.max(packed).alias("__best"))
    cols = []
    for c in df.columns:
        if c in key:
            cols.append(F.col(c))
        elif c in order_by:
            cols.append(F.col(f"__best.o{list(order_by).index(c)}").alias(c))
        else:
            cols.append(F.col(f"__best.r{rest.index(c)}").alias(c))
    return best.select(*cols)


def last_non_null_per_key(df: DataFrame, key: Sequence[str], order_by: str) -> DataFrame:
    """Fold several partial updates of one key: per field, the non-NULL value with the highest
    ``order_by`` (later patches win field by field; a NULL never overwrites)."""
    fields = [c for c in df.columns if c not in key and c != order_by]
    aggs = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order_by))).alias(c) for c in fields]
    aggs.append(F.max(order_by).alias(order_by))
    return df.groupBy(*key).agg(*aggs).select(*df.columns)
