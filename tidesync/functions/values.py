"""Column-level value rules: contract casts, empty-to-NULL, patch fallback, defaults, row size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidesync.contracts import TableContract


def empty_to_null(c: Column) -> Column:
    """A falsy string becomes NULL; every other value is kept."""
    return F.nullif(c, F.lit(""))


def cast_strict(c: Column, dtype: T.DataType) -> Column:
    """Null-safe cast to the contract type (NULL stays NULL)."""
    return c.cast(dtype)


def cast_checked(c: Column, dtype: T.DataType) -> Column:
    """Cast that yields NULL instead of failing (used to detect bad input)."""
    return c.try_cast(dtype)


def contract_column(df_col: Column, name: str, contract: TableContract, checked: bool = False,
                    keep_empty: bool = False) -> Column:
    """A column under the contract; ``keep_empty``: ``''`` stays (record ingest) and is not made NULL (load)."""
    dtype = contract.type_of(name)
    c = df_col
    if name in contract.empty_as_null and not keep_empty:
        c = empty_to_null(c.cast("string"))
    c = cast_checked(c, dtype) if checked else cast_strict(c, dtype)
    return c.alias(name)


def patch_value(patch_col: Column, current_col: Column) -> Column:
    """Patch rule: a NULL patch field means "not given", so the current value stays."""
    return F.coalesce(patch_col, current_col)


def with_defaults(df, contract: TableContract, overrides: dict[str, Column] | None = None):
    """Fill missing (NULL) fields of new records with the contract defaults.

    ``overrides`` supplies defaults that depend on the call, e.g. today's date.
    """
    fills = {c: F.expr(sql).cast(contract.type_of(c)) for c, sql in contract.defaults.items() if c in df.columns}
    for c, v in (overrides or {}).items():
        fills[c] = v.cast(contract.type_of(c)) if c in contract.columns else v
    return df.select(*[
        F.coalesce(F.col(c), fills[c]).alias(c) if c in fills else F.col(c) for c in df.columns
    ])


_FIXED_WIDTH = {
    T.ByteType: 8, T.ShortType: 8, T.IntegerType: 8, T.LongType: 8, T.FloatType: 8,
    T.DoubleType: 8, T.BooleanType: 8, T.DateType: 8, T.TimestampType: 8, T.TimestampNTZType: 8,
}


def row_bytes(schema: T.StructType) -> Column:
    """Upper estimate of the in-memory (UnsafeRow) size of one row, computed per row.

    Fixed-width fields take one 8-byte word; decimals up to 18 digits too, wider ones 16 bytes
    plus a word; strings and binary their UTF-8 length rounded up to 8 plus a word. Nested types
    are measured through their JSON text, which bounds them from above.
    """
    total: Column = F.lit(8 + (len(schema.fields) + 63) // 64 * 8)
    for f in schema.fields:
        t = f.dataType
        name = F.col(f"`{f.name}`")
        if type(t) in _FIXED_WIDTH:
            part = F.lit(8)
        elif isinstance(t, T.DecimalType):
            part = F.lit(8 if t.precision <= 18 else 24)
        elif isinstance(t, (T.StringType, T.BinaryType)):
            part = F.lit(8) + F.ceil(F.coalesce(F.octet_length(name), F.lit(0)) / 8) * 8
        else:
            part = F.lit(16) + F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0))
        total = total + part
    return total.cast("long")
