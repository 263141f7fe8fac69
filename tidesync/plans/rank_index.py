"""Rank index of a change-file table: row counts per key range, so a deep page reads the range that holds it.

``ORDER BY key OFFSET n`` has to know how many rows come before; without counts the whole key column is read.
The change-file layout keeps the table cut by key ranges, in key order. The index holds the number of live rows
of each range; their running sum tells which ranges hold the page, and only these are read and sorted.

A batch changes the files of the ranges that it touches, and only these are counted again: the record names, for
each range, the base folder and the change folders that its count was taken from. Counts are taken from a
version of the table and used with the same version, so a page is exact whatever is appended meanwhile.

The driver holds one number per range (the layout has at most ``MOST_RANGES`` of them). Rows with NULL keys are
in the first range and come first, as in ``operators.query.page``. A range is sorted by a top-k of the page's
offset inside it; beyond ``max_rest`` rows, for one integral key, by the histogram narrowing of ``deep_page``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidesync.operators import query
from tidesync.operators.ranges import range_of
from tidesync.plans import versions
from tidesync.plans.changelog import ChangeLog
from tidesync.streaming.sync import live_rows


def files_of(state: dict, number: int) -> list[str]:
    """What the rows of a range are read from: its base folder and its change folders."""
    changes = sorted(c["path"] for c in state["changes"] if number in c["ranges"])
    return [state["base"].get(str(number), ""), *changes]


@dataclass
class RankedPage:
    rows: DataFrame
    ranges_read: list[int]


@dataclass
class RankIndex:
    spark: SparkSession
    root: str                    # folder of the change-file table; the records are kept below it

    @property
    def folder(self) -> str:
        return f"{self.root}/ranks"

    def live(self, log: ChangeLog, ranges: Sequence[int]) -> DataFrame:
        return live_rows(log.read(ranges), log.state["seq"], log.state["op"])

    def refresh(self, log: ChangeLog | None = None) -> tuple[list[int], list[int]]:
        """Row counts of all ranges of ``log`` (default: the newest version), and the ranges counted anew."""
        log = log or ChangeLog.open(self.spark, self.root)
        found = versions.latest(self.spark, self.folder)
        known = found[1]["ranges"] if found and found[1]["bounds"] == log.state["bounds"] else {}
        files = {r: files_of(log.state, r) for r in log.ranges}
        stale = [r for r in log.ranges if known.get(str(r), {}).get("files") != files[r]]
        counts = {r: known[str(r)]["rows"] for r in log.ranges if r not in set(stale)}
        if stale:
            column = log.key[0]
            of = range_of(column, log.schema[column].dataType, log.state["bounds"]).alias("r")
            counted = self.live(log, stale).groupBy(of).agg(F.count(F.lit(1)).alias("n")).collect()
            counts.update({r: 0 for r in stale} | {row["r"]: row["n"] for row in counted})
            record = {"bounds": log.state["bounds"], "ranges": {str(r): {"files": files[r], "rows": counts[r]} for r in log.ranges}}
            versions.update(self.spark, self.folder, lambda old: record)
        return [counts[r] for r in log.ranges], stale

    def page(self, limit: int = query.DEFAULT_ORDER_PAGE, offset: int = 0, columns: Sequence[str] | None = None,
             max_rest: int = query.DEFAULT_MAX_TOPK) -> RankedPage:
        """``ORDER BY key LIMIT limit OFFSET offset`` over the live rows of the newest version."""
        if limit < 0 or offset < 0:
            raise ValueError("limit and offset must be >= 0")
        log = ChangeLog.open(self.spark, self.root)
        counts, _ = self.refresh(log)
        before, held, skipped = 0, [], None
        for number, n in enumerate(counts):
            if before < offset + limit and before + n > offset:
                skipped = before if skipped is None else skipped
                held.append(number)
            before += n
        if not held:
            empty = self.live(log, []).limit(0)
            return RankedPage(empty.select(*columns) if columns else empty, [])
        rows, rest = self.live(log, held), offset - skipped
        integral = len(log.key) == 1 and isinstance(log.schema[log.key[0]].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
        if rest > max_rest and integral:
            deep = query.deep_page(rows, log.key[0], limit, rest, max_rest)
            return RankedPage(deep.select(*columns) if columns else deep, held)
        return RankedPage(query.page(rows, log.key, columns, limit, rest), held)
