"""Key-bucketed tables: apply a change batch by rewriting only the buckets it touches.

A full rewrite per change batch costs O(table), which a large lake table cannot pay every few
minutes. Here the table is a catalog table partitioned by ``__bucket = pmod(xxhash64(key), B)``.
A batch of changes touches at most B buckets (usually far fewer): only those partitions are
read (partition pruning), merged with the batch, written to a fresh version folder, and then
each touched partition is pointed at its new folder (``ALTER TABLE ... PARTITION ... SET
LOCATION``). Untouched partitions keep their files.

Consistency: every key lives in exactly one bucket and each partition swap is one catalog call,
so a reader sees each key either before or after the batch; a reader that plans during the
swaps may see some buckets old and some new (no snapshot across buckets). Use the whole-table
swap of ``tidesync.plans.publish`` where readers need a snapshot. A batch interrupted between
swaps is repaired by re-running it: MERGE and the sync's seq rule are idempotent, and each
attempt writes its own version folder, so it never overwrites files that are being read.

The change functions used here never remove rows from a touched bucket (MERGE has no delete
clause, the sync keeps tombstones), so every touched bucket gets a folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidesync.functions.values import row_bytes
from tidesync.operators.sizing import Size
from tidesync.plans.publish import mark_owner
from tidesync.plans.versions import file_system

BUCKET = "__bucket"
PROP_KEY, PROP_BUCKETS, PROP_BATCH, PROP_STREAM, PROP_FILES = (
    "tidesync.key", "tidesync.buckets", "tidesync.batch", "tidesync.stream", "tidesync.filesPerBucket")
PROP_HASH, PROP_TYPES = "tidesync.hash", "tidesync.keyTypes"


#: How keys are hashed: by value in the table's stored key types. Tables that hash otherwise are refused.
HASH_VERSION = "typed-1"


class UnknownHashError(ValueError):
    pass


def bucket_of(key: Sequence[str], buckets: int, types: Sequence[str] | None = None) -> Column:
    """Bucket of a key: the hash of its values in ``types`` (the stored key types; None: as they are).

    Casting a batch's key to the stored type first makes equal keys hash alike whatever type the batch
    brings them in; the hash is of the value, never of its text, so neither the scale of a decimal nor the
    session's time zone matters. Integers hash as bigint.
    """
    cols = [F.col(k) for k in key] if types is None else [F.col(k).cast(t) for k, t in zip(key, types)]
    return F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int")


def key_types(df: DataFrame, key: Sequence[str]) -> tuple[str, ...]:
    """The types that a table hashes its key in: its own, integers as bigint."""
    own = [df.schema[k].dataType.simpleString() for k in key]
    return tuple("bigint" if t in ("tinyint", "smallint", "int") else t for t in own)


@dataclass(frozen=True)
class BucketedTable:
    name: str
    key: tuple[str, ...]
    buckets: int
    root: str
    files_per_bucket: int | None = None      # None: file count follows the data (REBALANCE)
    key_types: tuple[str, ...] | None = None

    def read(self, spark: SparkSession) -> DataFrame:
        """The table without the bucket column."""
        return spark.table(self.name).drop(BUCKET)


def _props(spark: SparkSession, name: str) -> dict[str, str]:
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}


def _write_buckets(df: DataFrame, key: Sequence[str], types: Sequence[str], buckets: int, n_buckets_written: int,
                   files_per_bucket: int | None, path: str) -> None:
    """Write ``df`` as ``path/__bucket=b/`` folders.

    Default (``files_per_bucket=None``): a ``REBALANCE`` by bucket. Rows of one bucket go to one
    shuffle partition, and AQE then splits a partition above
    ``spark.sql.adaptive.advisoryPartitionSizeInBytes`` along map outputs and merges small ones.
    A bucket holding a third of the table is thus written by many tasks into files of about the
    advisory size, and small buckets get one file, whatever the table size. (With AQE off the
    hint is a plain hash repartition: one task per bucket.)

    ``files_per_bucket=n``: rows go to ``n_buckets_written * n`` tasks by (bucket, salt), where the
    salt is a hash of the whole row (deterministic under task retries): exactly n files per bucket.

    Either way each task writes only its own buckets, instead of every task writing one small
    file per bucket it holds, and rows are sorted by key inside each file, so Parquet min/max
    statistics prune row groups for key lookups and key ranges.
    """
    out = df.withColumn(BUCKET, bucket_of(key, buckets, types))
    if files_per_bucket is None:
        out = out.hint("rebalance", BUCKET)
    else:
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(files_per_bucket))
        out = out.repartition(max(1, n_buckets_written * files_per_bucket), F.col(BUCKET), salt)
    out.sortWithinPartitions(BUCKET, *key).write.partitionBy(BUCKET).parquet(path)


def create(spark: SparkSession, name: str, df: DataFrame, key: Sequence[str], buckets: int, root: str,
           batch_id: int | None = None, files_per_bucket: int | None = None,
           stream: str | None = None) -> BucketedTable:
    """Write ``df`` partitioned by key bucket and register it as ``name``.

    The batch id is recorded last: a driver lost before that leaves a table without one, and the
    replayed batch is applied in full."""
    path = f"{root.rstrip('/')}/v-{uuid.uuid4().hex[:12]}"
    types = key_types(df, key)
    _write_buckets(df, key, types, buckets, buckets, files_per_bucket, path)
    mark_owner(spark, path, name)
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    props = {PROP_KEY: ",".join(key), PROP_BUCKETS: str(buckets),
             PROP_FILES: "auto" if files_per_bucket is None else str(files_per_bucket),
             PROP_HASH: HASH_VERSION, PROP_TYPES: ";".join(types)}
    prop_sql = ", ".join(f"'{k}'='{v}'" for k, v in props.items())
    spark.sql(f"CREATE TABLE {name} ({cols}, {BUCKET} int) USING parquet PARTITIONED BY ({BUCKET}) "
              f"LOCATION '{path}' TBLPROPERTIES ({prop_sql})")
    spark.sql(f"MSCK REPAIR TABLE {name}")
    record_batch(spark, name, batch_id, stream)
    return BucketedTable(name, tuple(key), buckets, root, files_per_bucket, types)


def open_table(spark: SparkSession, name: str, root: str) -> BucketedTable:
    p = _props(spark, name)
    if p.get(PROP_HASH) != HASH_VERSION:
        raise UnknownHashError(f"{name} hashes its keys by {p.get(PROP_HASH, 'an unrecorded rule')}, not by {HASH_VERSION}: "
                               "its buckets cannot be found; write it again with create()")
    files = p.get(PROP_FILES, "auto")
    return BucketedTable(name, tuple(p[PROP_KEY].split(",")), int(p[PROP_BUCKETS]), root,
                         None if files == "auto" else int(files), tuple(p[PROP_TYPES].split(";")))


def is_bucketed(spark: SparkSession, name: str) -> bool:
    """Whether ``name`` exists and was created by ``create`` (it carries the bucket properties)."""
    return spark.catalog.tableExists(name) and PROP_BUCKETS in _props(spark, name)


def last_batch(spark: SparkSession, name: str) -> tuple[int, str | None] | None:
    """The last applied micro-batch and the streaming query it came from."""
    props = _props(spark, name)
    return (int(props[PROP_BATCH]), props.get(PROP_STREAM) or None) if PROP_BATCH in props else None


def record_batch(spark: SparkSession, name: str, batch_id: int | None, stream: str | None) -> None:
    if batch_id is not None:
        spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{PROP_BATCH}'='{batch_id}', '{PROP_STREAM}'='{stream or ''}')")


def touched_buckets(changes: DataFrame, table: BucketedTable) -> list[int]:
    """Bucket ids of a change batch: at most ``table.buckets`` small integers."""
    rows = changes.select(bucket_of(table.key, table.buckets, table.key_types).alias("b")).distinct().collect()
    return sorted(r["b"] for r in rows)


def measure_touched(changes: DataFrame, key: Sequence[str], buckets: int,
                    types: Sequence[str] | None = None) -> tuple[Size, list[int]]:
    """Size of a change batch and the buckets it touches, from one aggregate (the bucket set is
    at most ``buckets`` small integers)."""
    row = changes.agg(F.count(F.lit(1)).alias("rows"), F.sum(row_bytes(changes.schema)).alias("bytes"),
                      F.collect_set(bucket_of(key, buckets, types or key_types(changes, key))).alias("touched")).first()
    return Size(int(row["rows"]), int(row["bytes"] or 0)), sorted(row["touched"])


def written_buckets(spark: SparkSession, path: str) -> set[int]:
    """Bucket folders below ``path``."""
    fs, where = file_system(spark, path)
    names = [st.getPath().getName() for st in fs.listStatus(where)]
    return {int(n.split("=", 1)[1]) for n in names if n.startswith(f"{BUCKET}=") and n.split("=", 1)[1].isdigit()}


def apply(spark: SparkSession, table: BucketedTable, changes: DataFrame,
          change_fn: Callable[[DataFrame, DataFrame], DataFrame], batch_id: int | None = None,
          touched: Sequence[int] | None = None, stream: str | None = None) -> list[int]:
    """Replace the touched buckets by ``change_fn(current rows of those buckets, changes)``.

    Returns the touched bucket ids. ``batch_id`` is recorded on the table after the swaps, for
    replay guards of streaming writers. ``touched`` passes bucket ids already known (e.g. from
    ``measure_touched``); otherwise one aggregate finds them.
    """
    touched = touched_buckets(changes, table) if touched is None else sorted(touched)
    if not touched:
        return touched
    current = spark.table(table.name).where(F.col(BUCKET).isin(touched)).drop(BUCKET)
    new_state = change_fn(current, changes)
    path = f"{table.root.rstrip('/')}/v-{uuid.uuid4().hex[:12]}"
    types = table.key_types or key_types(current, table.key)
    _write_buckets(new_state, table.key, types, table.buckets, len(touched), table.files_per_bucket, path)
    strange = written_buckets(spark, path) - set(touched)
    if strange:
        raise ValueError(f"keys of buckets {sorted(strange)} came out of a batch for {touched}: nothing was published")
    mark_owner(spark, path, table.name)
    existing = {int(r["partition"].split("=", 1)[1]) for r in spark.sql(f"SHOW PARTITIONS {table.name}").collect()}
    added = [b for b in touched if b not in existing]
    if added:
        spec = " ".join(f"PARTITION ({BUCKET}={b}) LOCATION '{path}/{BUCKET}={b}'" for b in added)
        spark.sql(f"ALTER TABLE {table.name} ADD IF NOT EXISTS {spec}")
    for b in touched:
        if b in existing:
            spark.sql(f"ALTER TABLE {table.name} PARTITION ({BUCKET}={b}) SET LOCATION '{path}/{BUCKET}={b}'")
    record_batch(spark, table.name, batch_id, stream)
    spark.sql(f"REFRESH TABLE {table.name}")
    return touched


def count_files(spark: SparkSession, paths: Sequence[str]) -> int:
    """Rows in committed Parquet folders, from the files' footers."""
    return spark.read.parquet(*paths).count() if paths else 0


def partition_locations(spark: SparkSession, name: str) -> dict[int, str]:
    """Bucket id → folder, from the catalog (one call per partition, at most B)."""
    out = {}
    for r in spark.sql(f"SHOW PARTITIONS {name}").collect():
        b = int(r["partition"].split("=", 1)[1])
        rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name} PARTITION ({BUCKET}={b})").collect()
        # the partition's own Location comes first; the table's follows under "Storage Information"
        out[b] = next(row["data_type"] for row in rows if row["col_name"] == "Location")
    return out
