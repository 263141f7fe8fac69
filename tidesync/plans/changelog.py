"""Change-file layout of a keyed copy: batches are appended, the latest row per key is taken at read.

A batch costs what it holds: it is written as small files of its own, cut by key range, and a new version
record lists them; nothing else is rewritten. A read merges the base with the changes since, by the
library's MERGE with the seq rule (a small set of changes is broadcast, the base is then not
shuffled). Compaction rewrites the ranges that have gathered changes, and only these.

* Layout below ``root``: ``versions/`` (numbered records), ``base-*`` and ``change-*`` folders, each with a
  sub-folder per key range. Folders are never written twice.
* A record names, per range, the base folder, and the change folders with the ranges of theirs that are
  not in the base yet. Its size follows the ranges and the changes since the last compaction.
* Readers of one record have a snapshot, whatever is published meanwhile; ``vacuum`` keeps the folders of
  the newest records and of records younger than a grace period.
* A record holds the last batch of each stream, so a replayed batch is recognised.

Rows carry ``seq`` and ``op`` columns; deletes stay as tombstones, so an older change that arrives late
cannot revive a row.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidesync.operators.changes import merge
from tidesync.operators.dedupe import latest_per_key
from tidesync.operators.ranges import in_ranges, key_bounds, range_of
from tidesync.operators.sizing import Size, measure
from tidesync.plans import versions

RANGE = "__range"
#: Change folders that a range gathers before ``compact_due`` rewrites it.
COMPACT_PARTS = 16
#: Estimated in-memory bytes of a key range and most ranges, where the number of ranges is not given.
RANGE_BYTES = 512 * 1024 * 1024
MOST_RANGES = 1024


@dataclass
class ChangeLog:
    """A table in change-file layout; ``state`` is the record that this object last read or wrote."""

    spark: SparkSession
    root: str
    version: int
    state: dict

    # ---- open and create ------------------------------------------------------------------------

    @staticmethod
    def exists(spark: SparkSession, root: str) -> bool:
        return versions.latest(spark, f"{root}/versions") is not None

    @staticmethod
    def open(spark: SparkSession, root: str, version: int | None = None) -> "ChangeLog":
        if version is None:
            found = versions.latest(spark, f"{root}/versions")
            if found is None:
                raise ValueError(f"no change-file table at {root}")
            return ChangeLog(spark, root, *found)
        return ChangeLog(spark, root, version, versions.get(spark, f"{root}/versions", version))

    @staticmethod
    def create(spark: SparkSession, root: str, schema: T.StructType, key: Sequence[str],
               bounds: Sequence[str] = (), seq_col: str = "seq", op_col: str = "op") -> "ChangeLog":
        """An empty table cut at ``bounds`` (see ``key_bounds``); the schema includes seq and op."""
        state = {"key": list(key), "seq": seq_col, "op": op_col, "schema": schema.jsonValue(), "bounds": list(bounds),
                 "base": {}, "changes": [], "batches": {}, "chunks": {}}
        versions.put(spark, f"{root}/versions", 1, state)
        return ChangeLog(spark, root, 1, state)

    @property
    def key(self) -> list[str]:
        return self.state["key"]

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(self.state["schema"])

    @property
    def ranges(self) -> list[int]:
        return list(range(len(self.state["bounds"]) + 1))

    def refreshed(self) -> "ChangeLog":
        return ChangeLog.open(self.spark, self.root)

    def publish(self, change) -> None:
        """Publish ``change(state)`` as the next version; ``change`` only edits the record it is given."""
        kept: list[dict] = []

        def edited(current: dict | None) -> dict | None:
            record = change(json.loads(json.dumps(current)))
            kept.append(record)
            return record

        self.version = versions.update(self.spark, f"{self.root}/versions", edited)
        self.state = kept[-1] if kept[-1] is not None else self.refreshed().state

    # ---- reading --------------------------------------------------------------------------------

    def _files(self, paths: Iterable[str]) -> DataFrame | None:
        paths = sorted(paths)
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else None

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def pending(self, ranges: Iterable[int] | None = None) -> tuple[DataFrame | None, Size]:
        """Changes that are not in the base yet, and an upper bound of their size (from the record)."""
        wanted = set(self.ranges if ranges is None else ranges)
        paths, rows, size = [], 0, 0
        for c in self.state["changes"]:
            here = [r for r in c["ranges"] if r in wanted]
            if here:
                paths += [f"{c['path']}/{RANGE}={r}" for r in here]
                rows, size = rows + c["rows"], size + c["bytes"]
        return self._files(paths), Size(rows, size)

    def read(self, ranges: Iterable[int] | None = None) -> DataFrame:
        """The rows of this version (tombstones, seq and op included), of all ranges or of some."""
        wanted = self.ranges if ranges is None else list(ranges)
        base = self._files(p for r, p in self.state["base"].items() if int(r) in set(wanted))
        changes, size = self.pending(wanted)
        if changes is None:
            return base if base is not None else self._empty()
        latest = latest_per_key(changes, self.key, [self.state["seq"]])
        if base is None:
            return latest
        return merge(base, latest, self.key, on_duplicate="trust", source_size=size, newer_than=self.state["seq"]).result

    def rows_between(self, low, high) -> DataFrame:
        """Rows with ``low <= first key column <= high``: only the ranges that may hold them are read."""
        column, dtype = self.key[0], self.schema[self.key[0]].dataType
        probe = self.spark.createDataFrame([(low,), (high,)], T.StructType([T.StructField(column, dtype)]))
        first, last = sorted(r[0] for r in probe.select(range_of(column, dtype, self.state["bounds"])).collect())
        return self.read(range(first, last + 1)).where(F.col(column).between(low, high))

    # ---- writing --------------------------------------------------------------------------------

    def _write(self, df: DataFrame, kind: str) -> str:
        """Write rows as one folder per key range; large ranges get several files, small ones one."""
        path = f"{self.root}/{kind}-{uuid.uuid4().hex[:12]}"
        of = range_of(self.key[0], self.schema[self.key[0]].dataType, self.state["bounds"])
        out = df.select(*self.schema.names).withColumn(RANGE, of).hint("rebalance", RANGE)
        out.sortWithinPartitions(RANGE, *self.key).write.partitionBy(RANGE).parquet(path)
        return path

    def _written(self, path: str) -> list[int]:
        fs, where = versions.file_system(self.spark, path)
        names = [st.getPath().getName() for st in fs.listStatus(where)]
        return sorted(int(n.split("=", 1)[1]) for n in names if n.startswith(f"{RANGE}="))

    def is_replay(self, batch_id: int | None, stream: str | None) -> bool:
        return batch_id is not None and self.state["batches"].get(stream or "", -1) >= batch_id

    def append(self, latest: DataFrame, size: Size, batch_id: int | None = None, stream: str | None = None) -> str | None:
        """Add a batch (one row per key) as change files. Returns its folder, or None for a replay."""
        if self.is_replay(batch_id, stream):
            return None
        path = self._write(latest, "change")
        entry = {"path": path, "ranges": self._written(path), "rows": size.rows, "bytes": size.bytes}

        def change(state: dict) -> dict | None:
            if batch_id is not None and state["batches"].get(stream or "", -1) >= batch_id:
                return None
            state["changes"].append(entry)
            if batch_id is not None:
                state["batches"][stream or ""] = batch_id
            return state

        self.publish(change)
        return path

    def set_base(self, df: DataFrame, ranges: Iterable[int], covered: Sequence[str] = (), batch_id: int | None = None,
                 stream: str | None = None, chunks: dict | None = None) -> str:
        """Make ``df`` the base of ``ranges``; ``covered`` names the change folders it already includes."""
        path = self._write(df, "base")
        written, replaced = set(self._written(path)), set(ranges)

        def change(state: dict) -> dict:
            for r in replaced:
                state["base"].pop(str(r), None)
                if r in written:
                    state["base"][str(r)] = f"{path}/{RANGE}={r}"
            for c in state["changes"]:
                if c["path"] in covered:
                    c["ranges"] = [r for r in c["ranges"] if r not in replaced]
            state["changes"] = [c for c in state["changes"] if c["ranges"]]
            if batch_id is not None:
                state["batches"][stream or ""] = batch_id
            state["chunks"].update(chunks or {})
            return state

        self.publish(change)
        return path

    def compact(self, ranges: Iterable[int] | None = None, least_parts: int = 1) -> list[int]:
        """Rewrite the base of the ranges that have at least ``least_parts`` change folders. Changes that
        are appended meanwhile stay. Ranges whose backfill chunk is still to come are left alone."""
        wanted = set(self.ranges if ranges is None else ranges)
        if self.state["chunks"]:
            wanted &= {int(r) for r, c in self.state["chunks"].items() if c["done"]}
        gathered = {r: sum(r in c["ranges"] for c in self.state["changes"]) for r in wanted}
        due = sorted(r for r, n in gathered.items() if n >= max(1, least_parts))
        if due:
            self.set_base(self.read(due), due, [c["path"] for c in self.state["changes"]])
        return due

    def compact_due(self, parts: int = COMPACT_PARTS) -> list[int]:
        return self.compact(least_parts=parts)

    # ---- retention ------------------------------------------------------------------------------

    def vacuum(self, keep_versions: int = 2, retain_seconds: float = 7 * 24 * 3600) -> list[str]:
        """Delete folders that no kept record names. Kept are the newest ``keep_versions`` records and those
        younger than ``retain_seconds``; folders younger than that stay too (a batch may be on its way)."""
        fs, root = versions.file_system(self.spark, self.root)
        cutoff = (time.time() - retain_seconds) * 1000
        used: set[str] = set()
        all_numbers = versions.numbers(self.spark, f"{self.root}/versions")
        for n in all_numbers:
            _, where = versions.file_system(self.spark, f"{self.root}/versions/v-{n:012d}.json")
            if n in all_numbers[-keep_versions:] or fs.getFileStatus(where).getModificationTime() > cutoff:
                state = versions.get(self.spark, f"{self.root}/versions", n) or {"base": {}, "changes": []}
                used |= {p.split("/")[-2] for p in state["base"].values()}
                used |= {c["path"].split("/")[-1] for c in state["changes"]}
            else:
                fs.delete(where, False)
        gone = []
        for st in fs.listStatus(root):
            name = st.getPath().getName()
            ours = name.startswith(("base-", "change-"))
            if ours and name not in used and st.getModificationTime() <= cutoff:
                fs.delete(st.getPath(), True)
                gone.append(name)
        return gone


def range_count(size: Size) -> int:
    return max(1, min(MOST_RANGES, -(-size.bytes // RANGE_BYTES)))


def create_from(spark: SparkSession, root: str, first: DataFrame, key: Sequence[str], ranges: int | None = None, seq_col: str = "seq",
                op_col: str = "op", batch_id: int | None = None, stream: str | None = None) -> ChangeLog:
    """A table whose base is ``first`` (one row per key, with seq and op), cut into about equal ranges
    (of about RANGE_BYTES each, unless their number is given).

    If the driver is lost before the base is published, the table is empty and records no batch, so the
    replayed batch finds it and is appended."""
    log = ChangeLog.create(spark, root, T.StructType([T.StructField(f.name, f.dataType) for f in first.schema.fields]),
                           key, key_bounds(first, key, ranges or range_count(measure(first))), seq_col, op_col)
    log.set_base(first, log.ranges, batch_id=batch_id, stream=stream)
    return log


# ---- resumable backfill --------------------------------------------------------------------------


def start_backfill(spark: SparkSession, root: str, source: DataFrame, key: Sequence[str], chunks: int = 32,
                   seq_col: str = "seq", op_col: str = "op") -> ChangeLog:
    """Open the table at ``root``, or create it empty with a ledger of one chunk per key range of ``source``."""
    if ChangeLog.exists(spark, root):
        log = ChangeLog.open(spark, root)
        if log.state["chunks"]:
            return log
        bounds = log.state["bounds"]                       # created by a run that was lost before its ledger
    else:
        bounds = key_bounds(source, key, chunks)
        fields = [T.StructField(f.name, f.dataType) for f in source.schema.fields if f.name not in (seq_col, op_col)]
        extra = [T.StructField(seq_col, T.LongType()), T.StructField(op_col, T.StringType())]
        log = ChangeLog.create(spark, root, T.StructType(fields + extra), key, bounds, seq_col, op_col)
    log.publish(lambda s: {**s, "chunks": {str(r): {"done": False} for r in range(len(bounds) + 1)}})
    return log


def run_backfill(log: ChangeLog, source, mark, max_chunks: int | None = None) -> int:
    """Copy the chunks that the ledger does not hold as done; returns how many were copied.

    ``source()`` gives the live source table as it is now, ``mark()`` the highest seq that the feed has
    given out (or None). A chunk's rows get the mark read *before* the chunk (the low mark) as their seq: a
    change of the same key after that has a higher seq and wins, whether it is applied before or after the
    chunk; a change at or below the mark was in the source already and loses. Rows, low and high mark and
    ``done`` are published in one record, so a run that is lost repeats the chunk it was in and no other.
    """
    done = 0
    column, dtype = log.key[0], log.schema[log.key[0]].dataType
    for r in sorted(int(r) for r, c in log.state["chunks"].items() if not c["done"]):
        if max_chunks is not None and done >= max_chunks:
            break
        low = mark()
        live = source()
        chunk = live.where(in_ranges(column, live.schema[column].dataType, log.state["bounds"], [r]))
        stamped = chunk.withColumns({
            log.state["seq"]: F.lit(low).cast("long"), log.state["op"]: F.lit(None).cast("string")})
        typed = stamped.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in log.schema.fields])
        log.set_base(typed, [r], chunks={str(r): {"done": True, "low": low, "high": mark()}})
        done += 1
    return done


# ---- groups: several tables, one cut --------------------------------------------------------------


def publish_group(spark: SparkSession, root: str, tables: dict[str, ChangeLog]) -> int:
    """Publish the current versions of several tables together: one record, so readers of the group see
    all tables before a cut or all after it."""
    cut = {name: {"root": log.root, "version": log.version} for name, log in tables.items()}
    return versions.update(spark, f"{root}/versions", lambda old: {"tables": {**(old or {}).get("tables", {}), **cut}})


def open_group(spark: SparkSession, root: str, version: int | None = None) -> dict[str, ChangeLog]:
    """The tables of the newest cut (or of an earlier one), each at the version of that cut."""
    if version is None:
        found = versions.latest(spark, f"{root}/versions")
        record = found[1] if found else {"tables": {}}
    else:
        record = versions.get(spark, f"{root}/versions", version)
    return {name: ChangeLog.open(spark, t["root"], t["version"]) for name, t in record["tables"].items()}


def apply_to_group(spark: SparkSession, root: str, batches: dict[str, DataFrame], keys: dict[str, Sequence[str]],
                   batch_id: int | None = None, ranges: int | None = None) -> int:
    """Apply one batch of changes per table and publish them as one cut.

    Each batch carries seq and op and is reduced to the latest change per key; a table that is not in the
    group yet is created from its batch. Run again after a failure (same ``batch_id``), tables that have the
    batch skip it, and the cut is published once all have it.
    """
    tables = open_group(spark, root)
    for name, batch in batches.items():
        where = f"{root}/{name}"
        log = ChangeLog.open(spark, where) if ChangeLog.exists(spark, where) else None
        if log is None or not log.is_replay(batch_id, None):
            latest = latest_per_key(batch, keys[name], ["seq"]).persist(StorageLevel.MEMORY_AND_DISK)
            try:
                if log is None:
                    log = create_from(spark, where, latest, keys[name], ranges, batch_id=batch_id)
                elif (size := measure(latest)).rows:
                    log.append(latest, size, batch_id)
            finally:
                latest.unpersist()
        tables[name] = log
    return publish_group(spark, root, tables)
