"""Continuous keyed sync of a change feed into a read-only keyed copy (Structured Streaming).

Each micro-batch is reduced to the latest change per key (highest ``seq``) and upserted with the
MERGE operator, which keeps a stored row whose ``seq`` is not lower than the change's;
rows flagged as deletes leave a tombstone so that an older change arriving late cannot revive
them. The new state is published by a location swap into a fresh folder whose name carries the
batch id and the id of the streaming query (from its checkpoint): a replayed batch (``foreachBatch``
is at-least-once) of the same query finds itself published and does nothing, while a query with a
new checkpoint, which counts its batches from 0 again, loses none. The end state does not depend on
how the feed is cut into micro-batches, as long as two different changes of a key never share a
``seq`` (of such two, the one of the earlier batch stays).
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidesync.operators.changes import merge
from tidesync.operators.dedupe import latest_per_key
from tidesync.operators.sizing import Size, measure
from tidesync.plans import bucketed, changelog
from tidesync.plans.publish import publish_swap, table_location

DELETE_OP = "D"


def apply_changes(target: DataFrame | None, latest: DataFrame, key: Sequence[str], seq_col: str,
                  size: Size | None = None) -> DataFrame:
    """New state of the copy after one batch of changes, already reduced to one row per key
    (the copy stores ``seq`` and ``op``). ``target=None``: the first batch, i.e. the backfill.

    One MERGE with ``newer_than=seq``: a stored key is replaced only by a change with a higher
    ``seq`` (a change without ``seq`` never replaces one that has it); new keys are inserted.
    The copy's key and ``seq`` columns are scanned once, inside the MERGE.
    """
    key = list(key)
    if target is None:
        return latest
    size = size if size is not None else measure(latest)
    return merge(target, latest, key, on_duplicate="trust", source_size=size, newer_than=seq_col).result


def live_rows(copy: DataFrame, seq_col: str = "seq", op_col: str = "op") -> DataFrame:
    """The read-only view: tombstones hidden, bookkeeping columns dropped."""
    return copy.where(F.col(op_col).isNull() | (F.col(op_col) != DELETE_OP)).drop(seq_col, op_col, bucketed.BUCKET)


def sync_batch_writer(target_table: str, root: str, key: Sequence[str], seq_col: str = "seq",
                      op_col: str = "op", layout: str = "swap", buckets: int = 64,
                      checkpoint: str | None = None, reader: SparkSession | None = None,
                      ranges: int | None = None, compact_parts: int = changelog.COMPACT_PARTS):
    """The ``foreachBatch`` function of the sync.

    ``checkpoint`` is the folder of the streaming query, whose id tells its replays from the batches
    of another query; ``reader`` is the session to refresh after each new version.

    ``layout="swap"`` rewrites the copy per batch and swaps the table location (a snapshot per
    batch); ``layout="buckets"`` keeps the copy partitioned by key bucket and rewrites only the
    buckets the batch touches (``tidesync.plans.bucketed``); ``layout="log"`` appends the batch as change
    files and compacts key ranges that have gathered enough of them (``tidesync.plans.changelog``): what a
    batch writes follows the batch, not the copy. A log copy has no catalog table; it is read with
    ``read_log``.
    """
    if layout == "log":
        return _log_writer(root, key, seq_col, op_col, checkpoint, ranges, compact_parts)
    if layout == "buckets":
        return _bucketed_writer(target_table, root, key, seq_col, op_col, buckets, checkpoint, reader)
    if layout != "swap":
        raise ValueError(f"layout must be 'swap', 'buckets' or 'log', not {layout!r}")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stream = query_id(spark, checkpoint)
        loc = table_location(spark, target_table)
        published = VERSION.search(loc.rstrip("/")) if loc is not None else None
        if published and _is_replay((int(published[1]), published[2]), batch_id, stream):
            return                                          # replay of a published batch
        version = f"batch-{batch_id:012d}.{stream or 'none'}.{uuid.uuid4().hex[:12]}"
        if op_col not in batch.columns:
            batch = batch.withColumn(op_col, F.lit(None).cast("string"))
        target = spark.table(target_table) if loc is not None else None
        cols = target.columns if target is not None else batch.columns
        # reduced once, reused by the size check, the seq filter and the merge of this batch
        latest = latest_per_key(batch.select(*cols), key, [seq_col]).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            size = measure(latest)
            if size.rows == 0:
                return
            publish_swap(apply_changes(target, latest, key, seq_col, size), target_table, root, version)
            _refresh(reader, target_table)
        finally:
            latest.unpersist()

    return write


VERSION = re.compile(r"/batch-([0-9]+)\.([^./]+)\.[0-9a-f]+$")


def query_id(spark: SparkSession, checkpoint: str | None) -> str | None:
    """Id of the streaming query that owns a checkpoint, as Spark stores it there."""
    if checkpoint is None:
        return None
    rows = spark.read.text(f"{checkpoint.rstrip('/')}/metadata", wholetext=True).collect()
    return json.loads(rows[0][0])["id"]


def _is_replay(done: tuple[int, str | None], batch_id: int, stream: str | None) -> bool:
    """Whether a batch was applied already; a writer without a checkpoint goes by the batch id alone."""
    return done[0] >= batch_id and (stream is None or done[1] == stream)


def _refresh(reader: SparkSession | None, table: str) -> None:
    """Let the session that started the sync see the new version (a batch runs in a session of its own)."""
    if reader is not None:
        reader.sql(f"REFRESH TABLE {table}")


def _bucketed_writer(target_table: str, root: str, key: Sequence[str], seq_col: str, op_col: str, buckets: int,
                     checkpoint: str | None, reader: SparkSession | None):
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stream = query_id(spark, checkpoint)
        exists = spark.catalog.tableExists(target_table)
        if exists:
            done = bucketed.last_batch(spark, target_table)
            if done is not None and _is_replay(done, batch_id, stream):
                return                                      # replay of an applied batch
        if op_col not in batch.columns:
            batch = batch.withColumn(op_col, F.lit(None).cast("string"))
        table = bucketed.open_table(spark, target_table, root) if exists else None
        cols = table.read(spark).columns if exists else batch.columns
        latest = latest_per_key(batch.select(*cols), key, [seq_col]).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            # one aggregate: empty check, broadcast size check and touched buckets
            size, touched = bucketed.measure_touched(latest, key, table.buckets if exists else buckets,
                                                     table.key_types if exists else None)
            if size.rows == 0:
                return
            if not exists:
                bucketed.create(spark, target_table, latest, key, buckets, root, batch_id, stream=stream)
                _refresh(reader, target_table)
                return
            bucketed.apply(spark, table, latest,
                           lambda current, changes: apply_changes(current, changes, key, seq_col, size),
                           batch_id, touched, stream)
            _refresh(reader, target_table)
        finally:
            latest.unpersist()

    return write


def _log_writer(root: str, key: Sequence[str], seq_col: str, op_col: str, checkpoint: str | None, ranges: int | None,
                compact_parts: int):
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stream = query_id(spark, checkpoint)
        log = changelog.ChangeLog.open(spark, root) if changelog.ChangeLog.exists(spark, root) else None
        if log is not None and log.is_replay(batch_id, stream):
            return
        if op_col not in batch.columns:
            batch = batch.withColumn(op_col, F.lit(None).cast("string"))
        cols = log.schema.names if log is not None else batch.columns
        latest = latest_per_key(batch.select(*cols), key, [seq_col]).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            size = measure(latest)
            if size.rows == 0:
                return
            if log is None:
                changelog.create_from(spark, root, latest, key, ranges, seq_col, op_col, batch_id, stream)
                return
            log.append(latest, size, batch_id, stream)
            log.compact_due(compact_parts)
        finally:
            latest.unpersist()

    return write


def read_log(spark: SparkSession, root: str) -> DataFrame:
    """The live rows of a copy in the ``log`` layout."""
    log = changelog.ChangeLog.open(spark, root)
    return live_rows(log.read(), log.state["seq"], log.state["op"])


def sync_table(feed: DataFrame, target_table: str, root: str, key: Sequence[str], checkpoint: str,
               seq_col: str = "seq", op_col: str = "op", trigger: dict | None = None,
               query_name: str | None = None, layout: str = "swap", buckets: int = 64, ranges: int | None = None,
               compact_parts: int = changelog.COMPACT_PARTS) -> StreamingQuery:
    """Start the sync of the streaming DataFrame ``feed`` into ``target_table``.

    ``trigger`` is passed to ``DataStreamWriter.trigger``; the default processes what is
    available and stops (``availableNow``), the shape of a scheduled run. Use
    ``{"processingTime": "15 minutes"}`` for a continuously running copy.
    """
    writer = (feed.writeStream
              .foreachBatch(sync_batch_writer(target_table, root, key, seq_col, op_col, layout, buckets,
                                              checkpoint, feed.sparkSession, ranges, compact_parts))
              .option("checkpointLocation", checkpoint)
              .trigger(**(trigger or {"availableNow": True})))
    if query_name:
        writer = writer.queryName(query_name)
    return writer.start()


def sync_files(spark: SparkSession, feed_path: str, schema, target_table: str, root: str,
               key: Sequence[str], checkpoint: str, max_files_per_trigger: int = 1, **kw) -> StreamingQuery:
    """Sync from Parquet change files landing in ``feed_path``; the first files are the backfill."""
    feed = (spark.readStream.schema(schema).option("maxFilesPerTrigger", str(max_files_per_trigger))
            .parquet(feed_path))
    return sync_table(feed, target_table, root, key, checkpoint, **kw)
