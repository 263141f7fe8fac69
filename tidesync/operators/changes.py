"""Change operators on keyed tables: MERGE, strict insert, patch, delete, insert-if-absent.

Each takes the current table and a batch as DataFrames and returns DataFrames: the new state of
the table, the affected rows and per-key outcomes. Writing the new state is kept apart
(``tidesync.plans.publish``), so every operator can be checked against an SQL oracle.

Two NULL rules live here and are never mixed:
* MERGE copies every source column unconditionally, so a NULL in the source overwrites.
* A patch sets only fields that are given, so a NULL field keeps the current value.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidesync.operators.dedupe import (
    DuplicateKeyError,
    duplicate_keys,
    latest_per_key,
    require_unique,
)
from tidesync.operators.keys import KeyJoin, without_keys
from tidesync.operators.sizing import Size, fits_broadcast, hinted, key_size, measure, measure_keyed

HIT = "__src_hit"
SRC = "__src_"

#: Heavy keys that a split merge sets apart, at most.
MOST_HEAVY = 1000

# Outcome labels (the HTTP codes of a row-at-a-time service become labels of a batch).
UPDATE, INSERT, STALE = "update", "insert", "stale"
APPLIED, NO_FIELDS, NOT_FOUND, CONFLICT_EXISTS, CONFLICT_DUP = (
    "applied", "no_fields", "not_found", "exists", "duplicate_in_batch")
DELETED, INSERTED = "deleted", "inserted"


def _align(df: DataFrame, target: DataFrame, fill: dict[str, Column] | None = None) -> DataFrame:
    """Project ``df`` onto the target's columns and types; absent columns become ``fill`` or NULL."""
    fill = fill or {}
    cols = []
    for f in target.schema.fields:
        if f.name in fill:
            cols.append(fill[f.name].cast(f.dataType).alias(f.name))
        elif f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


# --------------------------------------------------------------------------------------------
# MERGE
# --------------------------------------------------------------------------------------------

@dataclass
class MergeResult:
    result: DataFrame        # new state of the target
    classes: DataFrame       # one row per source key: key..., match_class ('update' | 'insert' | 'stale')
    strategy: str            # 'broadcast', 'shuffle' or 'split' (heavy keys by broadcast, the rest by shuffle)
    source_size: Size
    deleted: DataFrame | None = None   # target keys removed (only with delete_missing)
    observations: list[Observation] = field(default_factory=list)   # with merge(observe=True)

    def metrics(self) -> DataFrame:
        return merge_metrics(self.classes, self.deleted)

    def observed_metrics(self) -> dict[str, int]:
        """The metrics counted while ``result`` was computed (``merge(observe=True)``), without a
        job of their own. Call only after an action on ``result`` (e.g. its write) has finished."""
        if not self.observations:
            raise ValueError("pass observe=True to merge()")
        got: Counter[str] = Counter()
        for o in self.observations:
            got.update(o.get)                            # adds; a split merge counts in both of its parts
        upd, ins = int(got.get("num_updated_rows", 0)), int(got.get("num_inserted_rows", 0))
        dele = int(got.get("num_deleted_rows", 0))
        return {"num_affected_rows": upd + ins + dele, "num_updated_rows": upd,
                "num_deleted_rows": dele, "num_inserted_rows": ins}


def prepare_source(source: DataFrame, key: Sequence[str], on_duplicate: str = "error",
                   order_by: Sequence[str] = ()) -> DataFrame:
    """Enforce one source row per key: raise (default) or keep the latest by ``order_by``."""
    if on_duplicate == "error":
        require_unique(source, key, "merge source")
        return source
    if on_duplicate == "latest":
        return latest_per_key(source, key, order_by)
    if on_duplicate == "trust":
        return source
    raise ValueError(f"on_duplicate must be 'error', 'latest' or 'trust', not {on_duplicate!r}")


def merge(target: DataFrame, source: DataFrame, key: Sequence[str], *, on_duplicate: str = "error",
          order_by: Sequence[str] = (), source_size: Size | None = None,
          strategy: str | None = None, newer_than: str | None = None,
          delete_missing: bool = False,
          pin: Callable[[DataFrame], DataFrame] | None = None,
          observe: bool = False, heavy_rows: int | None = None) -> MergeResult:
    """Upsert ``source`` into ``target`` by ``key``.

    Matched: every source column overwrites the target's (NULL included). Not matched: the source
    row is inserted. Target rows without a source row are kept. Target columns the source lacks
    keep their value on update and are NULL on insert. Target rows that repeat a key are all updated;
    ``classes`` has their key once. These are the defaults; two options differ
    on purpose:

    * ``newer_than=c``: a matched row is updated only when the source's ``c`` is greater than the
      target's (or the target's is NULL); otherwise it is kept and classed ``stale``.
    * ``delete_missing=True``: target rows whose key is not in the source are removed (the source
      is a complete snapshot).

    Plans: when the source passes the broadcast size check the target is streamed once through a
    broadcast left join (no shuffle of the target) and scanned once more for its key column only
    to find the matched keys; otherwise one full outer sort-merge join shuffles both sides.

    ``pin``: materialises the source rows flagged with their match (at most |source| rows), for
    callers that read both the metrics and the new state: the key scan of the target then runs
    once, and both read the same matches. It must return a DataFrame with the same rows, e.g. one
    written to the shared folder and read back.

    ``observe=True``: the updated, inserted (and deleted) rows are counted inside the plan of
    ``result`` (``DataFrame.observe``), in the stage that writes it, and read with
    ``observed_metrics()`` after that write. No job of their own, and in the shuffle plan no second
    pass over the target's keys.

    ``heavy_rows=n``: for targets that repeat keys, where the shuffle plan would bring all rows of a key to
    one task (AQE splits no full outer join). Keys with n target rows or more are measured by one aggregate (at most
    MOST_HEAVY of them: the limit is raised to a share of the target). Their target rows stay where they are
    and meet their source rows, one per key, by a broadcast of checked size; the rest takes the shuffle plan. Both
    parts are decided by the same null-safe key test, so a row is in exactly one.
    """
    key = list(key)
    extra = [c for c in source.columns if c not in target.columns]
    if extra:
        raise ValueError(f"source columns not in target: {extra}")
    if newer_than is not None and newer_than not in source.columns:
        raise ValueError(f"newer_than column {newer_than!r} not in source")
    if on_duplicate == "error" and source_size is None:
        size, top = measure_keyed(source, key)           # size check and key check in one pass
        if top > 1:
            raise DuplicateKeyError(f"merge source repeats keys {key}; pass on_duplicate='latest' with order_by")
    else:
        source = prepare_source(source, key, on_duplicate, order_by)
        size = source_size if source_size is not None else measure(source)
    spark = source.sparkSession
    if strategy is None:
        strategy = "broadcast" if fits_broadcast(spark, size) else "shuffle"
    if strategy == "shuffle" and heavy_rows is not None:
        heavy = heavy_keys(target, key, heavy_rows)
        mine = None if heavy is None else with_keys(source, heavy, key, True)
        heavy_size = None if mine is None else measure(mine)
        if fits_broadcast(spark, heavy_size):
            options = dict(on_duplicate="trust", newer_than=newer_than, delete_missing=delete_missing, pin=pin, observe=observe)
            parts = [
                merge(with_keys(target, heavy, key, False), with_keys(source, heavy, key, False), key,
                      source_size=size, strategy="shuffle", **options),
                merge(with_keys(target, heavy, key, True), mine, key, source_size=heavy_size, strategy="broadcast", **options),
            ]
            a, b = parts
            return MergeResult(a.result.unionByName(b.result), a.classes.unionByName(b.classes), "split", size,
                               a.deleted.unionByName(b.deleted) if delete_missing else None, a.observations + b.observations)

    value_cols = [c for c in target.columns if c not in key and c in source.columns]
    flagged = source.select(*key, *[F.col(c).alias(SRC + c) for c in value_cols], F.lit(True).alias(HIT))
    apply = F.col(HIT).isNotNull()
    if newer_than is not None:
        apply = apply & (F.col(newer_than).isNull() | (F.col(SRC + newer_than) > F.col(newer_than)))

    observations: list[Observation] = []

    def watch(df: DataFrame, counts: dict[str, Column]) -> DataFrame:
        if not observe:
            return df
        o = Observation(f"tidesync_merge_{uuid.uuid4().hex[:12]}")
        observations.append(o)
        return df.observe(o, *[F.count(F.when(c, 1)).alias(n) for n, c in counts.items()])

    def merged_value(c: str) -> Column:
        if c in key:
            return F.col(c)
        dtype = target.schema[c].dataType
        if c in value_cols:
            return F.when(apply, F.col(SRC + c).cast(dtype)).otherwise(F.col(c)).alias(c)
        return F.col(c)

    src_stamp = [F.col(newer_than).alias("__s_stamp")] if newer_than else []
    tgt_keys = target.select(*key, *([F.col(newer_than).alias("__t_stamp")] if newer_than else []))
    small = strategy == "broadcast"

    def one_per_key(matched: DataFrame) -> DataFrame:
        """A target that repeats a key gives one match (reduced map-side first), so the matches never
        outgrow the source, whose size was measured."""
        stamp = [F.max("__t_stamp").alias("__t_stamp")] if newer_than else []
        return matched.groupBy(*key).agg(*stamp) if stamp else matched.distinct()

    if small:
        joined = watch(target.join(F.broadcast(flagged), key, "left"),
                       {"num_updated_rows": apply,
                        **({"num_deleted_rows": F.col(HIT).isNull()} if delete_missing else {})})
        kept = joined.where(F.col(HIT).isNotNull()) if delete_missing else joined
        updated = kept.select(*[merged_value(c) for c in target.columns])
        hits = one_per_key(tgt_keys.join(F.broadcast(source.select(*key)), key, "left_semi"))   # <= |source| rows
        # One outer join of the source with the matched keys gives both the inserts and the match
        # classes. (An anti join would be pushed through a Union in the source and repeat the
        # key scan of the target once per branch.)
        src_matched = source.join(F.broadcast(hits.withColumn("__t", F.lit(True))), key, "left")
        if pin is not None:
            src_matched = pin(src_matched)
        inserts = _align(watch(src_matched.where(F.col("__t").isNull()), {"num_inserted_rows": F.lit(True)}),
                         target)
        result = updated.unionByName(inserts)
    else:
        joined = target.withColumn("__t", F.lit(True)).join(flagged, key, "full_outer")
        t_here, s_here = F.col("__t").isNotNull(), F.col(HIT).isNotNull()
        joined = watch(joined, {"num_updated_rows": t_here & apply, "num_inserted_rows": ~t_here & s_here,
                                **({"num_deleted_rows": t_here & ~s_here} if delete_missing else {})})
        kept = joined.where(F.col(HIT).isNotNull()) if delete_missing else joined
        result = kept.select(*[merged_value(c) for c in target.columns])
        hits = one_per_key(tgt_keys.join(source.select(*key), key, "left_semi"))
        src_matched = source.join(hits.withColumn("__t", F.lit(True)), key, "left")
        if pin is not None:
            src_matched = pin(src_matched)
    classes = src_matched.select(*key, "__t", *(["__t_stamp"] if newer_than else []), *src_stamp)
    matched_class = F.lit(UPDATE)
    if newer_than is not None:
        matched_class = F.when(F.col("__t_stamp").isNull() | (F.col("__s_stamp") > F.col("__t_stamp")),
                               F.lit(UPDATE)).otherwise(F.lit(STALE))
    classes = classes.select(*key, F.when(F.col("__t"), matched_class).otherwise(F.lit(INSERT)).alias("match_class"))
    deleted = None
    if delete_missing:
        deleted = target.select(*key).join(hinted(source.select(*key), small), key, "left_anti")
    return MergeResult(result, classes, strategy, size, deleted, observations)


def heavy_keys(target: DataFrame, key: Sequence[str], heavy_rows: int) -> DataFrame | None:
    """Keys with at least ``heavy_rows`` rows of the target, or None; at most MOST_HEAVY, since a key counts as heavy
    only if it also holds that share of the rows. Rows are counted per key with partial sums before the shuffle."""
    least = max(heavy_rows, -(-target.count() // MOST_HEAVY))
    counts = target.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).drop("__n")
    found = counts.collect()
    return target.sparkSession.createDataFrame(found, counts.schema) if found else None


def with_keys(rows: DataFrame, few: DataFrame, key: Sequence[str], inside: bool) -> DataFrame:
    """Rows whose key is (or is not) among ``few`` keys, NULL counted as a value; ``few`` is small by a proven bound."""
    names = {k: f"__few_{k}" for k in key}
    cond = None
    for k, n in names.items():
        same = rows[k].eqNullSafe(F.col(n))
        cond = same if cond is None else cond & same
    return rows.join(F.broadcast(few.withColumnsRenamed(names)), cond, "left_semi" if inside else "left_anti")


def merge_metrics(classes: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """One row: affected, updated, deleted and inserted rows (deleted is 0 without delete_missing)."""
    counts = classes.agg(
        F.count(F.when(F.col("match_class") == UPDATE, 1)).alias("num_updated_rows"),
        F.count(F.when(F.col("match_class") == INSERT, 1)).alias("num_inserted_rows"),
    )
    if deleted is None:
        n_deleted = F.lit(0).cast("long")
    else:
        n_deleted = deleted.agg(F.count(F.lit(1))).scalar()
    return counts.select(
        (F.col("num_updated_rows") + F.col("num_inserted_rows") + n_deleted).alias("num_affected_rows"),
        "num_updated_rows",
        n_deleted.alias("num_deleted_rows"),
        "num_inserted_rows",
    )


# --------------------------------------------------------------------------------------------
# Strict insert
# --------------------------------------------------------------------------------------------

@dataclass
class InsertResult:
    result: DataFrame        # target plus inserted rows
    inserted: DataFrame      # the rows written (RETURNING *)
    conflicts: DataFrame     # key..., reason ('exists' | 'duplicate_in_batch')


def insert_strict(target: DataFrame, batch: DataFrame, key: Sequence[str], *,
                  stamp: tuple[str, Column] | None = None,
                  pin: Callable[[DataFrame], DataFrame] | None = None) -> InsertResult:
    """Insert rows whose key is new. A key already in the target, or repeated inside the batch,
    is a conflict and none of its rows is inserted. ``stamp=(column, value)`` sets the insert
    stamp (the column default of the staging table).

    ``pin`` materialises the judged batch (a row per batch row, flagged; e.g. written to the shared folder
    and read back), for callers that use more than one output: the batch and the target's keys are then
    read once, and all outputs agree."""
    key = list(key)
    if pin is not None:
        return _insert_pinned(target, batch, key, stamp, pin)
    dups = duplicate_keys(batch, key).select(*key)
    spark = batch.sparkSession
    size = measure(batch.select(*key))
    small = fits_broadcast(spark, key_size(size, len(key)))
    unique_rows = batch.join(hinted(dups, small), key, "left_anti")
    kj = KeyJoin(target, unique_rows, key, batch_size=size)
    exists = kj.present()
    inserted_raw = without_keys(unique_rows, exists, key, small)
    fill = {stamp[0]: stamp[1]} if stamp else None
    inserted = _align(inserted_raw, target, fill)
    conflicts = (exists.select(*key, F.lit(CONFLICT_EXISTS).alias("reason"))
                 .unionByName(dups.select(*key, F.lit(CONFLICT_DUP).alias("reason"))))
    return InsertResult(target.unionByName(inserted), inserted, conflicts)


def _insert_pinned(target: DataFrame, batch: DataFrame, key: list[str], stamp: tuple[str, Column] | None,
                   pin: Callable[[DataFrame], DataFrame]) -> InsertResult:
    spark = batch.sparkSession
    rows, flag, n = "__row", "__present", "__n"
    per_key = batch.groupBy(*key).agg(F.count(F.lit(1)).alias(n), F.any_value(F.struct(*batch.columns)).alias(rows))
    kj = KeyJoin(target, per_key.select(*key), key)
    judged = pin(per_key.join(hinted(kj.flagged_present(flag).distinct(), kj.small), key, "left"))
    new = judged.where((F.col(n) == 1) & F.col(flag).isNull()).select(f"{rows}.*")
    inserted = _align(new, target, {stamp[0]: stamp[1]} if stamp else None)
    reason = F.when(F.col(n) > 1, F.lit(CONFLICT_DUP)).otherwise(F.lit(CONFLICT_EXISTS)).alias("reason")
    conflicts = judged.where((F.col(n) > 1) | F.col(flag).isNotNull()).select(*key, reason)
    return InsertResult(target.unionByName(inserted), inserted, conflicts)


# --------------------------------------------------------------------------------------------
# Patch (partial update)
# --------------------------------------------------------------------------------------------

@dataclass
class PatchResult:
    result: DataFrame        # target with patches applied
    changed: DataFrame       # patched rows after the change (RETURNING *)
    outcomes: DataFrame      # key..., outcome ('applied' | 'no_fields' | 'not_found' | 'duplicate_in_batch')


def patch_update(target: DataFrame, patches: DataFrame, key: Sequence[str], *,
                 stamp: tuple[str, Column] | None = None, order_by: str | None = None) -> PatchResult:
    """Apply partial updates: only non-NULL patch fields are set, so 0 and '' are applied and
    NULL can never be set; the key itself cannot be patched.

    One aggregate over the batch gives, per key, the number of patches with and without fields
    and the values to set. A key with no field in any patch is ``no_fields`` (rejected before
    any lookup); several patches of one key are folded field by field in ``order_by`` order
    (the latest non-NULL value wins), or rejected as ``duplicate_in_batch`` when no order is
    given; an unknown key is ``not_found``. Each patched key gets exactly one outcome.
    """
    key = list(key)
    fields = [c for c in patches.columns if c not in key and c != order_by]
    unknown = [c for c in fields if c not in target.columns]
    if unknown:
        raise ValueError(f"patch fields not in target: {unknown}")
    any_given = F.lit(False)
    for c in fields:
        any_given = any_given | F.col(c).isNotNull()
    if order_by:
        values = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order_by))).alias(SRC + c) for c in fields]
    else:
        # only read where exactly one patch has fields: its non-NULL values are the only candidates
        values = [F.first(F.col(c), ignorenulls=True).alias(SRC + c) for c in fields]
    per_key = patches.groupBy(*key).agg(F.count(F.when(any_given, 1)).alias("__n_given"), *values)
    dup = (F.col("__n_given") > 1) if not order_by else F.lit(False)
    usable = per_key.where((F.col("__n_given") > 0) & ~dup)
    spark = patches.sparkSession
    size = measure(usable)                             # one pass decides both joins below
    small = fits_broadcast(spark, size)
    kj = KeyJoin(target, usable, key, batch_size=size)
    found = kj.flagged_present("__found")
    pflag = usable.select(*key, *[SRC + c for c in fields], F.lit(True).alias(HIT))

    def patched(c: str) -> Column:
        dtype = target.schema[c].dataType
        if c in fields:
            return F.when(F.col(HIT), F.coalesce(F.col(SRC + c).cast(dtype), F.col(c))).otherwise(F.col(c)).alias(c)
        if stamp and c == stamp[0]:
            return F.when(F.col(HIT), stamp[1].cast(dtype)).otherwise(F.col(c)).alias(c)
        return F.col(c)

    result = target.join(hinted(pflag, small), key, "left").select(*[patched(c) for c in target.columns])
    changed = target.join(hinted(pflag, small), key, "inner").select(*[patched(c) for c in target.columns])
    outcome = (F.when(F.col("__n_given") == 0, F.lit(NO_FIELDS))
               .when(dup, F.lit(CONFLICT_DUP))
               .when(F.col("__found"), F.lit(APPLIED))
               .otherwise(F.lit(NOT_FOUND)))
    outcomes = (per_key.select(*key, "__n_given").join(hinted(found, kj.small), key, "left")
                .select(*key, outcome.alias("outcome")))
    return PatchResult(result, changed, outcomes)


# --------------------------------------------------------------------------------------------
# Delete
# --------------------------------------------------------------------------------------------

@dataclass
class DeleteResult:
    result: DataFrame        # target without the deleted keys
    outcomes: DataFrame      # key..., outcome ('deleted' | 'not_found')


def delete_by_keys(target: DataFrame, keys: DataFrame, key: Sequence[str]) -> DeleteResult:
    key = list(key)
    kj = KeyJoin(target, keys.select(*key).distinct(), key)
    outcomes = (kj.present().select(*key, F.lit(DELETED).alias("outcome"))
                .unionByName(kj.missing_keys().select(*key, F.lit(NOT_FOUND).alias("outcome"))))
    return DeleteResult(kj.table_without(), outcomes)


# --------------------------------------------------------------------------------------------
# Insert-if-absent (seed)
# --------------------------------------------------------------------------------------------

@dataclass
class SeedResult:
    result: DataFrame        # target plus the new rows
    new_rows: DataFrame      # candidate rows that were inserted
    counts: DataFrame        # one row: seeded, attempted


def insert_if_absent(target: DataFrame, candidates: DataFrame, key: Sequence[str], *,
                     stamp: tuple[str, Column] | None = None) -> SeedResult:
    """Insert candidates whose key is absent; existing rows are never touched
    (``ON CONFLICT DO NOTHING``). Repeated candidate keys insert one row (the greatest by all
    columns, a fixed choice); every candidate row counts as attempted."""
    key = list(key)
    per_key = latest_per_key(candidates, key)
    kj = KeyJoin(target, per_key, key)
    new_rows = _align(kj.absent_rows(), target, {stamp[0]: stamp[1]} if stamp else None)
    counts = (candidates.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
              .join(hinted(kj.flagged_present(), kj.small), key, "left")
              .agg(F.count(F.when(F.col("__present").isNull(), 1)).alias("seeded"),
                   F.coalesce(F.sum("__n"), F.lit(0)).cast("long").alias("attempted")))
    return SeedResult(target.unionByName(new_rows), new_rows, counts)
