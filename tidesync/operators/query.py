"""Reads of a keyed table: optional text search, counts, ordered pages, keyset pages, page stats.

Ordered pages become ``TakeOrderedAndProject``: every task keeps at most ``offset + limit`` rows.
That bound is set by the request, so a deep offset on a huge table would hold a huge heap per
task. ``page`` always keeps that plan. ``deep_page`` is an explicit call for an integral key: it
first narrows the key range holding rank ``offset`` with exact histograms (one aggregate each, at
most ``bins`` rows to the driver) and then takes a small top-k from that range. ``keyset_page`` is the cheapest form for sequential paging: its key predicate reaches the
Parquet scan (row-group pruning) and keeps only ``limit`` rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidesync.functions.text import search_predicate

DEFAULT_ORDER_PAGE = 50
DEFAULT_CUSTOMER_PAGE = 100
DEFAULT_MAX_TOPK = 100_000


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def search(df: DataFrame, text_col: str, term: str | None = "", literal: bool = False) -> DataFrame:
    """Rows whose ``text_col`` contains ``term`` case-insensitively; empty term = all rows."""
    pred = search_predicate(text_col, term, literal)
    return df if pred is None else df.where(pred)


def count_rows(df: DataFrame, text_col: str | None = None, term: str | None = "",
               literal: bool = False, alias: str = "count") -> DataFrame:
    """One-row count, under the optional search."""
    base = search(df, text_col, term, literal) if text_col else df
    return base.agg(F.count(F.lit(1)).alias(alias))


def page(df: DataFrame, key: str | Sequence[str], columns: Sequence[str] | None = None,
         limit: int = DEFAULT_ORDER_PAGE, offset: int = 0) -> DataFrame:
    """``ORDER BY key LIMIT limit OFFSET offset`` over the (projected) table."""
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must be >= 0")
    keys = _keys(key)
    base = df.select(*columns) if columns else df
    ordered = base.orderBy(*[F.col(k).asc() for k in keys])
    return ordered.offset(offset).limit(limit) if offset else ordered.limit(limit)


def rank_boundary(df: DataFrame, key: str, offset: int, max_rest: int, bins: int = 4096) -> tuple[int, int] | None:
    """Exact ``(lo, rest)``: rows with ``key < lo`` number ``offset - rest`` and ``rest <= max_rest``
    (or the range is one key value). ``None`` when the table has at most ``offset`` rows.

    Each round is one aggregate over the key column of the current range: an equal-width
    histogram of at most ``bins`` buckets, collected to the driver (bounded by ``bins``).
    """
    stats = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(key).alias("n")).first()
    if stats["n"] is None or stats["n"] <= offset:
        return None
    lo, hi, below = int(stats["lo"]), int(stats["hi"]), 0
    while True:
        width = max(1, -(-(hi - lo + 1) // bins))
        # decimal difference and integer division: exact, and no overflow, for the whole long range
        bucket = F.expr(f"(cast(`{key}` as decimal(38,0)) - cast({lo} as decimal(38,0))) div cast({width} as decimal(38,0))")
        hist = (df.where((F.col(key) >= lo) & (F.col(key) <= hi)).groupBy(bucket.alias("b"))
                .agg(F.count(F.lit(1)).alias("n")).collect())
        cum = below
        for row in sorted(hist, key=lambda r: r["b"]):
            if cum + row["n"] > offset:
                lo, hi = lo + row["b"] * width, min(hi, lo + (row["b"] + 1) * width - 1)
                below = cum
                break
            cum += row["n"]
        else:
            return None                                     # rows vanished between passes
        if offset - below <= max_rest or width == 1:
            return lo, offset - below


def deep_page(df: DataFrame, key: str, limit: int, offset: int, max_rest: int = DEFAULT_MAX_TOPK,
              bins: int = 4096) -> DataFrame:
    """``ORDER BY key LIMIT limit OFFSET offset`` for a deep offset on an integral key, exact,
    with a top-k heap of at most ``max_rest + limit`` rows per task.

    Meant for unique keys (the primary key). When many rows share one key value the narrowing
    stops at that value and the heap is bounded by the size of that tie group instead; the order
    inside a tie group is not defined by ``ORDER BY key`` anyway.
    """
    nulls = df.where(F.col(key).isNull()).count()
    if offset < nulls:                                      # NULL keys come first, as in ``page``
        return df.orderBy(F.col(key).asc()).offset(offset).limit(limit)
    df, offset = df.where(F.col(key).isNotNull()), offset - nulls
    found = rank_boundary(df, key, offset, max_rest, bins)
    if found is None:
        return df.limit(0)
    lo, rest = found
    ordered = df.where(F.col(key) >= F.lit(lo)).orderBy(F.col(key).asc())
    return ordered.offset(rest).limit(limit) if rest else ordered.limit(limit)


def search_page(df: DataFrame, key: str | Sequence[str], text_col: str, term: str | None = "",
                limit: int = DEFAULT_ORDER_PAGE, offset: int = 0, literal: bool = False) -> DataFrame:
    return page(search(df, text_col, term, literal), key, None, limit, offset)


def _after(keys: list[str], last: Sequence) -> Column:
    """Lexicographic ``(k1, k2, ...) > (v1, v2, ...)`` as plain comparisons (pushable)."""
    cond = None
    for i in range(len(keys) - 1, -1, -1):
        here = F.col(keys[i]) > F.lit(last[i])
        if cond is None:
            cond = here
        else:
            cond = here | ((F.col(keys[i]) == F.lit(last[i])) & cond)
    return cond


def keyset_page(df: DataFrame, key: str | Sequence[str], after: Sequence | object | None = None,
                limit: int = DEFAULT_ORDER_PAGE, columns: Sequence[str] | None = None) -> DataFrame:
    """Next ``limit`` rows after the key ``after`` (exclusive); ``None`` = first page.

    Same rows as ``page`` with the matching offset, but the cost does not grow with depth.
    """
    keys = _keys(key)
    base = df.select(*columns) if columns else df
    if after is not None:
        last = list(after) if isinstance(after, (list, tuple)) else [after]
        base = base.where(_after(keys, last))
    return base.orderBy(*[F.col(k).asc() for k in keys]).limit(limit)


def page_stats(df: DataFrame, limit: int = DEFAULT_ORDER_PAGE, offset: int = 0,
               text_col: str | None = None, term: str | None = "", literal: bool = False) -> DataFrame:
    """Pager figures from one count: total, page number, page count (at least 1), first and
    last row shown (1-based), and whether a previous / next page exists."""
    total = F.col("total_rows")
    return count_rows(df, text_col, term, literal, alias="total_rows").select(
        total,
        F.lit(offset // limit + 1).cast("long").alias("page_number"),
        F.greatest(F.ceil(total / F.lit(limit)).cast("long"), F.lit(1).cast("long")).alias("page_count"),
        F.lit(offset + 1).cast("long").alias("first_shown"),
        F.least(F.lit(offset + limit).cast("long"), total).alias("last_shown"),
        F.lit(offset != 0).alias("has_previous"),
        (F.lit(offset + limit) < total).alias("has_next"),
    )


def get_by_key(df: DataFrame, key: str | Sequence[str], value: Sequence | object) -> DataFrame:
    """Point lookup; the equality reaches the scan (Parquet row groups, JDBC WHERE)."""
    keys = _keys(key)
    vals = list(value) if isinstance(value, (list, tuple)) else [value]
    cond = None
    for k, v in zip(keys, vals):
        c = F.col(k) == F.lit(v)
        cond = c if cond is None else cond & c
    return df.where(cond)
