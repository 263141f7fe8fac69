"""Text predicates for keyed search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wildcard_wrap(term: str) -> str:
    """``term`` → ``%term%``; wildcards inside the term stay active (as in the ILIKE search)."""
    return f"%{term}%"


def escape_like(term: str, escape: str = "\\") -> str:
    """Escape ``%``, ``_`` and the escape character so that a term matches literally."""
    out = []
    for ch in term:
        if ch in ("%", "_", escape):
            out.append(escape)
        out.append(ch)
    return "".join(out)


def contains_ci(column: str | Column, term: str, literal: bool = False) -> Column:
    """Case-insensitive substring match of ``term``.

    Default: ``column ILIKE '%term%'``, where ``%`` and ``_`` inside the term act as wildcards and
    ``\\`` escapes. ``literal=True`` matches the term as plain text. Both stay JVM-side;
    Catalyst rewrites the pattern to ``Contains(lower(c), ...)`` where it can.
    """
    c = F.col(column) if isinstance(column, str) else column
    pattern = wildcard_wrap(escape_like(term) if literal else term)
    return c.ilike(pattern)


def search_predicate(column: str | Column, term: str | None, literal: bool = False) -> Column | None:
    """Optional filter: an empty or missing term means no filter (``None``)."""
    if not term:
        return None
    return contains_ci(column, term, literal)
