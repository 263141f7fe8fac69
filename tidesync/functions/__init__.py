"""Column expressions (all built-in Spark functions, no Python UDFs)."""

from tidesync.functions.text import contains_ci, escape_like, search_predicate, wildcard_wrap
from tidesync.functions.values import (
    cast_checked,
    cast_strict,
    contract_column,
    empty_to_null,
    patch_value,
    row_bytes,
    with_defaults,
)

__all__ = [
    "contains_ci", "escape_like", "search_predicate", "wildcard_wrap",
    "cast_checked", "cast_strict", "contract_column", "empty_to_null", "patch_value", "row_bytes", "with_defaults",
]
