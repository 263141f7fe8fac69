"""Registered queries: each operator of the library run on the given tables.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame. Inputs are the lake tables of
``sf_dir`` and the change batches derived from them (``tidesync.sources.fixtures``); every
operator runs over its whole target table. ``tidesync.oracle`` holds the SQL twin of each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidesync.contracts import CLONE_TABLES, CUSTOMER_VIEW_COLUMNS, ORDER_CREATE_REQUIRED, ORDERS, STAMP_COLUMN, TPCH_KEYS
from tidesync.functions.values import with_defaults
from tidesync.operators import changes, checks, diff, query
from tidesync.operators.keys import KeyJoin
from tidesync.operators.load import typed
from tidesync.plans import bucketed, changelog, clone, forward, incremental, key_sketch, publish, rank_index, search_index
from tidesync.session import scratch_path
from tidesync.sources import fixtures, ingest, tables
from tidesync.streaming import sync

KEY = ["o_orderkey"]

# Request parameters of the registered queries.
SEARCH_TERM = "urgent order for customer 7"          # plain term
WILDCARD_TERM = "1-u%customer 4_"                    # % and _ act as wildcards
STATS_TERM = "urgent"
LOOKUP_KEY = 1230
PAGE_LIMIT, PAGE_OFFSET = 50, 100
SEARCH_PAGE_OFFSET = 50
CUSTOMER_LIMIT, CUSTOMER_OFFSET = 100, 200
KEYSET_AFTER = 149
DEEP_OFFSET, DEEP_MAX_REST = 12_345, 1_000
SEED_SIZE = 100
RANKED_OFFSET = 1_234
HEAVY_ROWS = 200
BUCKETS = 16
SEARCH_FILES = 16
RANGES = 8


def _lake(spark, d):
    return tables.lake_orders(spark, d)


class _Inputs:
    """The lake orders of one data set and the change batches derived from them."""

    def __init__(self, spark, d):
        self.lake = _lake(spark, d)
        self.span = fixtures.key_span(self.lake)
        self.staging = fixtures.staging(self.lake, self.span)

    def patches(self):
        return fixtures.patches(self.staging, self.lake, self.span)

    def delete_keys(self):
        return fixtures.delete_keys(self.staging, self.lake, self.span)

    def insert_batch(self):
        return fixtures.insert_batch(self.lake, self.span)


def _staging(spark, d):
    return _Inputs(spark, d).staging


def _merge(spark, d) -> changes.MergeResult:
    i = _Inputs(spark, d)
    return changes.merge(i.lake, i.staging, KEY)


# ---- sources --------------------------------------------------------------------------------

def snapshot_clone(spark: SparkSession, d: str) -> DataFrame:
    """Clone the lake orders into an own schema; a second clone from changed data is a no-op."""
    root = scratch_path(spark, "clone")
    schema = "tidesync_clone_" + root.rsplit("-", 1)[-1]
    publish.create_schema(spark, schema, f"{root}/db")
    target = f"{schema}.orders"
    i = _Inputs(spark, d)
    clone.snapshot_clone(spark, i.lake, target)
    clone.snapshot_clone(spark, i.staging, target)               # exists: left untouched
    return spark.table(target)


def clone_row_counts(spark: SparkSession, d: str) -> DataFrame:
    root = scratch_path(spark, "clone")
    schema = "tidesync_clone_" + root.rsplit("-", 1)[-1]
    clone.clone_tables(spark, tables.tpch_tables(spark, d, CLONE_TABLES), schema, f"{root}/db", parallelism=4)
    return clone.row_counts(spark, schema, CLONE_TABLES)


def staging_scan(spark: SparkSession, d: str) -> DataFrame:
    """The staging table as the serving store holds it, scanned whole (9 order columns)."""
    path = scratch_path(spark, "staging")
    _staging(spark, d).write.parquet(path)
    return typed(spark.read.parquet(path), ORDERS)


def typed_staging(spark: SparkSession, d: str) -> DataFrame:
    """Text-only staging rows (every 90th status empty) typed under the order contract."""
    staged = _staging(spark, d)
    raw = staged.select(*[
        F.when(F.col("o_orderkey") % 90 == 0, F.lit("")).otherwise(F.col(c)).alias(c) if c == "o_orderstatus"
        else F.col(c).cast("string").alias(c) for c in ORDERS.columns])
    return typed(raw, ORDERS)


def seed_candidates(spark: SparkSession, d: str) -> DataFrame:
    return tables.seed_scan(_lake(spark, d), SEED_SIZE)


def ingest_accept(spark: SparkSession, d: str) -> DataFrame:
    return ingest.parse_records(fixtures.json_records(_staging(spark, d)), ORDERS).accepted


def ingest_reject_counts(spark: SparkSession, d: str) -> DataFrame:
    return ingest.parse_records(fixtures.json_records(_staging(spark, d)), ORDERS).reject_counts()


def ingest_new_order_reject_counts(spark: SparkSession, d: str) -> DataFrame:
    """The same records read as new-order requests, where every field is required."""
    return ingest.parse_records(fixtures.json_records(_staging(spark, d)), ORDERS,
                                required=ORDER_CREATE_REQUIRED).reject_counts()


# ---- search, lookups, counts, pages ------------------------------------------------------------

def search_text(spark, d):
    return query.search(_lake(spark, d), "o_comment", SEARCH_TERM)


def _indexed_lake(spark, d) -> search_index.SearchIndex:
    """The lake orders written in customer order and indexed, half of the files by a second, extending call."""
    root = scratch_path(spark, "search")
    lake = _lake(spark, d)
    index = search_index.SearchIndex(spark, f"{root}/lake", "o_comment", f"{root}/index")
    for half in (0, 1):
        part = lake.where(F.col("o_custkey") % 2 == half)
        part.repartitionByRange(SEARCH_FILES, "o_comment").write.mode("append").parquet(index.folder)
        index.extend()
    return index


def search_text_indexed(spark, d):
    """The search reading only files that hold all of the term's trigrams."""
    return _indexed_lake(spark, d).search(SEARCH_TERM).rows


def count_search_indexed(spark, d):
    """Counts under a plain and a wildcard term through the index."""
    index = _indexed_lake(spark, d)
    counts = [query.count_rows(index.search(t).rows, alias="n_rows").select(F.lit(t).alias("term"), "n_rows")
              for t in (SEARCH_TERM, WILDCARD_TERM)]
    return counts[0].unionByName(counts[1])


def search_empty_term(spark, d):
    return query.search(_lake(spark, d), "o_comment", "")


def get_by_key(spark, d):
    return query.get_by_key(_lake(spark, d), "o_orderkey", LOOKUP_KEY)


def get_by_keys(spark, d):
    i = _Inputs(spark, d)
    return KeyJoin(i.staging, i.delete_keys(), KEY).table_rows()


def missing_keys(spark, d):
    i = _Inputs(spark, d)
    return KeyJoin(i.staging, i.delete_keys(), KEY).missing_keys()


def count_all(spark, d):
    return query.count_rows(_lake(spark, d), alias="count")


def count_search(spark, d):
    return query.count_rows(_lake(spark, d), "o_comment", STATS_TERM, alias="count")


def page_stats(spark, d):
    return query.page_stats(_lake(spark, d), PAGE_LIMIT, PAGE_OFFSET, "o_comment", STATS_TERM)


def page_orders(spark, d):
    return query.page(_lake(spark, d), "o_orderkey", None, PAGE_LIMIT, PAGE_OFFSET)


def page_search(spark, d):
    return query.search_page(_lake(spark, d), "o_orderkey", "o_comment", WILDCARD_TERM, PAGE_LIMIT, SEARCH_PAGE_OFFSET)


def page_deep(spark, d):
    """A deep page taken by histogram narrowing (top-k heap bounded by DEEP_MAX_REST + limit)."""
    return query.deep_page(_lake(spark, d), "o_orderkey", PAGE_LIMIT, DEEP_OFFSET, max_rest=DEEP_MAX_REST)


def page_customers(spark, d):
    cust = tables.read_table(spark, d, "customer")
    return query.page(cust, "c_custkey", CUSTOMER_VIEW_COLUMNS, CUSTOMER_LIMIT, CUSTOMER_OFFSET)


def page_keyset(spark, d):
    return query.keyset_page(_lake(spark, d), "o_orderkey", KEYSET_AFTER, PAGE_LIMIT)


# ---- changes ------------------------------------------------------------------------------------

def merge_orders(spark, d):
    return _merge(spark, d).result


def merge_match_classes(spark, d):
    return _merge(spark, d).classes


def merge_metrics(spark, d):
    return _merge(spark, d).metrics()


def merge_twice(spark, d):
    i = _Inputs(spark, d)
    once = changes.merge(i.lake, i.staging, KEY).result
    return changes.merge(once, i.staging, KEY).result


def merge_shuffle(spark, d):
    """The same MERGE planned as one full outer sort-merge join (the plan for large sources)."""
    i = _Inputs(spark, d)
    return changes.merge(i.lake, i.staging, KEY, strategy="shuffle").result


def merge_split(spark, d):
    """Customers' clerks merged into the orders by customer key, where one customer holds a third of the
    orders: the heavy key is split off and merged by broadcast, the rest by the sort-merge plan."""
    lake = fixtures.skewed_orders(_lake(spark, d))
    return changes.merge(lake, fixtures.customer_clerks(tables.read_table(spark, d, "customer")), ["o_custkey"],
                         strategy="shuffle", heavy_rows=HEAVY_ROWS).result


def merge_latest(spark, d):
    """MERGE of a staging batch that repeats keys, keeping the latest row per key (by price)."""
    i = _Inputs(spark, d)
    return changes.merge(i.lake, fixtures.staging_dup(i.staging), KEY, on_duplicate="latest",
                         order_by=["o_totalprice"]).result


def staging_key_violations(spark, d):
    return checks.key_violations(fixtures.staging_dup(_staging(spark, d)), KEY)


def forward_merge(spark, d):
    """The forward job end to end: the lake orders published as a table, the staging merged into
    it and the new version published; returns the table as published."""
    root = scratch_path(spark, "forward")
    name = "tidesync_forward_" + root.rsplit("-", 1)[-1]
    i = _Inputs(spark, d)
    publish.publish_swap(i.lake, name, root)
    run = forward.forward_merge(spark, i.staging, name, root)
    assert run.status == "merged"
    return spark.table(name)


def _forward_bad_rows(spark, d) -> tuple[str, forward.ForwardRun]:
    """The forward job, run twice, on a staging that holds rows without key and with over-long text."""
    root = scratch_path(spark, "forwardr")
    name = "tidesync_forwardr_" + root.rsplit("-", 1)[-1]
    i = _Inputs(spark, d)
    publish.publish_swap(i.lake, name, root)
    staging = fixtures.staging_with_bad_rows(i.staging)
    run = forward.forward_merge(spark, staging, name, root)
    forward.forward_merge(spark, staging, name, root)
    return name, run


def forward_with_bad_rows(spark, d):
    """The target after both runs: bad rows never reach it and the second run changes nothing."""
    return spark.table(_forward_bad_rows(spark, d)[0])


def forward_rejects(spark, d):
    """Rejected rows of a run by reason."""
    run = _forward_bad_rows(spark, d)[1]
    return spark.read.parquet(run.rejects).groupBy("reason").agg(F.count("*").alias("n_rows"))


def forward_metrics(spark, d):
    """Counters of the first run."""
    run = _forward_bad_rows(spark, d)[1]
    names = sorted(run.metrics)
    return spark.createDataFrame([tuple(run.metrics[n] for n in names)], ", ".join(f"{n} long" for n in names))


def forward_merge_buckets(spark, d):
    """The forward job on a key-bucketed lake table: only buckets holding staged keys are
    rewritten; returns the whole table afterwards."""
    root = scratch_path(spark, "forwardb")
    name = "tidesync_forwardb_" + root.rsplit("-", 1)[-1]
    i = _Inputs(spark, d)
    table = bucketed.create(spark, name, i.lake, KEY, BUCKETS, root)
    run = forward.forward_merge_buckets(spark, i.staging, table)
    assert run.status == "merged"
    return table.read(spark)


def _incremental(spark, d):
    """Three incremental runs: the earlier staging, the later one, and that one again (nothing changed)."""
    root = scratch_path(spark, "incremental")
    name = "tidesync_incremental_" + root.rsplit("-", 1)[-1]
    i = _Inputs(spark, d)
    publish.publish_swap(i.lake, name, root)
    earlier, later = (fixtures.stamped_staging(i.staging, late) for late in (False, True))
    incremental.forward_incremental(spark, earlier, name, root)
    run = incremental.forward_incremental(spark, later, name, root)
    again = incremental.forward_incremental(spark, later, name, root)
    assert again.status == "no_rows"
    return name, run


def forward_incremental(spark, d):
    """The target after incremental runs; equal to one full run over the last staging."""
    return spark.table(_incremental(spark, d)[0])


def forward_incremental_metrics(spark, d):
    """Counters of the second run: it fetches what changed, late rows included."""
    run = _incremental(spark, d)[1]
    names = sorted(run.metrics)
    return spark.createDataFrame([tuple(run.metrics[n] for n in names)], ", ".join(f"{n} long" for n in names))


def forward_incremental_buckets(spark, d):
    """The incremental runs on a key-bucketed lake table."""
    root = scratch_path(spark, "incrementalb")
    name = "tidesync_incrementalb_" + root.rsplit("-", 1)[-1]
    i = _Inputs(spark, d)
    table = bucketed.create(spark, name, i.lake, KEY, BUCKETS, root)
    for late in (False, True):
        incremental.forward_incremental_buckets(spark, fixtures.stamped_staging(i.staging, late), table)
    return table.read(spark)


def insert_strict(spark, d):
    i = _Inputs(spark, d)
    return changes.insert_strict(i.staging, i.insert_batch(), KEY).result


def _sketched_insert(spark, d):
    """A strict insert into the whole lake orders, kept in buckets with key sketches."""
    root = scratch_path(spark, "sketch")
    name = "tidesync_sketch_" + root.rsplit("-", 1)[-1]
    i = _Inputs(spark, d)
    table = bucketed.create(spark, name, i.lake, KEY, BUCKETS, root)
    sketch = key_sketch.KeySketch(spark, table, f"{root}/sketches")
    sketch.refresh()
    done = sketch.insert_strict(i.insert_batch(), pin=lambda df: publish.materialize(df, scratch_path(spark, "judged")))
    return table, done.insert


def insert_sketched(spark, d):
    """The lake orders after the insert; only buckets that may hold a key of the batch were looked at."""
    table, done = _sketched_insert(spark, d)
    key_sketch.publish_inserts(spark, table, done.inserted)
    return table.read(spark)


def insert_sketched_conflicts(spark, d):
    return _sketched_insert(spark, d)[1].conflicts


def insert_conflicts(spark, d):
    i = _Inputs(spark, d)
    return changes.insert_strict(i.staging, i.insert_batch(), KEY).conflicts


def _stamped(df: DataFrame) -> DataFrame:
    """The staging as the serving store holds it: with its stamp column."""
    return df.withColumn(STAMP_COLUMN, F.lit("2000-01-01 00:00:00+00").cast("timestamp"))


def _now():
    return STAMP_COLUMN, F.lit(fixtures.AS_OF_TIMESTAMP + "+00").cast("timestamp")


def _stamp_seconds(df: DataFrame) -> DataFrame:
    """The stamp as seconds since 1970, which no session's time zone changes."""
    return df.select(*ORDERS.columns, F.unix_seconds(STAMP_COLUMN).alias("last_modified_s"))


def insert_returning(spark, d):
    """The rows that a strict insert wrote, with the insert stamp; the judged batch is written once."""
    i = _Inputs(spark, d)
    path = scratch_path(spark, "insert")
    return _stamp_seconds(changes.insert_strict(_stamped(i.staging), i.insert_batch(), KEY, stamp=_now(),
                                                pin=lambda df: publish.materialize(df, path)).inserted)


def patch_returning(spark, d):
    """The patched rows after the change, with the modification stamp."""
    i = _Inputs(spark, d)
    return _stamp_seconds(changes.patch_update(_stamped(i.staging), i.patches(), KEY, stamp=_now()).changed)


def json_out(spark, d):
    """The lake orders written as JSON lines and read back: key and digest of each record."""
    path = scratch_path(spark, "json")
    publish.write_json(_lake(spark, d), path)
    key = F.get_json_object("value", "$.o_orderkey").cast("long").alias("o_orderkey")
    return spark.read.text(path).select(key, F.md5(F.col("value").cast("binary")).alias("record_md5"))


def missing_table_page(spark, d):
    """A page of a synced copy that does not exist yet: empty, with the customer columns."""
    schema = tables.read_table(spark, d, "customer").schema
    copy = tables.table_or_empty(spark, "tidesync_copy_that_is_not_there_yet", schema)
    return query.page(copy, "c_custkey", CUSTOMER_VIEW_COLUMNS, CUSTOMER_LIMIT, 0)


def delete_from_lake(spark, d):
    """Delete by key on the whole lake orders (the large target), not on the staging."""
    i = _Inputs(spark, d)
    return changes.delete_by_keys(i.lake, i.delete_keys(), KEY).result


def patch_update(spark, d):
    i = _Inputs(spark, d)
    return changes.patch_update(i.staging, i.patches(), KEY).result


def patch_outcomes(spark, d):
    i = _Inputs(spark, d)
    return changes.patch_update(i.staging, i.patches(), KEY).outcomes


def delete_by_key(spark, d):
    i = _Inputs(spark, d)
    return changes.delete_by_keys(i.staging, i.delete_keys(), KEY).result


def delete_outcomes(spark, d):
    i = _Inputs(spark, d)
    return changes.delete_by_keys(i.staging, i.delete_keys(), KEY).outcomes


def _seed(spark, d) -> changes.SeedResult:
    i = _Inputs(spark, d)
    return changes.insert_if_absent(i.staging, tables.seed_scan(i.lake, SEED_SIZE), KEY)


def seed_new_rows(spark, d):
    return _seed(spark, d).new_rows


def seed_counts(spark, d):
    return _seed(spark, d).counts


def seed_result(spark, d):
    return _seed(spark, d).result


def fill_defaults(spark, d):
    sparse = fixtures.sparse_new_orders(_staging(spark, d))
    return with_defaults(sparse, ORDERS, {"o_orderdate": F.lit(fixtures.AS_OF_DATE).cast("date")})


# ---- contracts ------------------------------------------------------------------------------

def key_violations(spark, d):
    return checks.key_violations(tables.read_table(spark, d, "lineitem", ["l_orderkey", "l_linenumber"]),
                                 TPCH_KEYS["lineitem"])


def key_violation_summary(spark, d):
    tbls = tables.tpch_tables(spark, d, CLONE_TABLES)
    return checks.key_summaries(tbls, TPCH_KEYS)


def length_violations(spark, d):
    flat = ingest.flatten_records(fixtures.json_records(_staging(spark, d)), ORDERS)
    return checks.length_violations(flat, ORDERS)


# ---- streaming --------------------------------------------------------------------------------

def sync_final_state(spark, d):
    """Lake snapshot (seq 0) then the staging as four change files (seq 1-4, the seq-1 file
    arriving last with stale copies of later keys) streamed one file per micro-batch into a
    keyed copy; returns the live rows of the copy."""
    return _sync(spark, d, "swap")


def sync_final_state_buckets(spark, d):
    """The same sync into a key-bucketed copy (each micro-batch rewrites only its buckets)."""
    return _sync(spark, d, "buckets")


def sync_final_state_log(spark, d):
    """The same sync into a copy in change-file layout: each micro-batch appends what it holds, ranges with
    three change folders are compacted, and the rest is merged at read."""
    return _sync(spark, d, "log")


def _sync(spark, d, layout: str):
    root = scratch_path(spark, "sync")
    feed = f"{root}/feed"
    i = _Inputs(spark, d)
    schema_cols = ORDERS.columns + ["seq"]
    i.lake.withColumn("seq", F.lit(0).cast("long")).select(*schema_cols).write.mode("append").parquet(feed)
    parts = fixtures.change_feed_parts(i.staging, 4)
    for part in parts[1:] + parts[:1]:
        fixtures.change_files(part.select(*schema_cols), KEY).write.mode("append").parquet(feed)
    name = "tidesync_sync_" + root.rsplit("-", 1)[-1]
    schema = spark.read.parquet(feed).schema
    q = sync.sync_files(spark, feed, schema, name, f"{root}/table", KEY, f"{root}/checkpoint",
                        max_files_per_trigger=1, layout=layout, buckets=BUCKETS, ranges=RANGES, compact_parts=3)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return sync.read_log(spark, f"{root}/table") if layout == "log" else sync.live_rows(spark.table(name))


def sync_two_checkpoints(spark, d):
    """Two feeds into one copy, each by a streaming query with a checkpoint of its own: the second one
    counts its batches from 0 again and none of them is lost."""
    root = scratch_path(spark, "sync2")
    i = _Inputs(spark, d)
    cols = ORDERS.columns + ["seq"]
    parts = fixtures.change_feed_parts(i.staging, 4)
    backfill = i.lake.withColumn("seq", F.lit(0).cast("long"))
    name = "tidesync_sync2_" + root.rsplit("-", 1)[-1]
    for n, feed_parts in enumerate(([backfill, parts[1]], [parts[2], parts[3], parts[0]])):
        feed = f"{root}/feed-{n}"
        for part in feed_parts:
            part.select(*cols).write.mode("append").parquet(feed)
        q = sync.sync_files(spark, feed, spark.read.parquet(feed).schema, name, f"{root}/table", KEY,
                            f"{root}/checkpoint-{n}", max_files_per_trigger=64)
        q.awaitTermination()
        if q.exception():
            raise q.exception()
    return sync.live_rows(spark.table(name))


def snapshot_changes(spark, d):
    """Changes between the lake orders and the merged state without every 70th key: digests of key ranges
    first, rows of the differing ranges then."""
    i = _Inputs(spark, d)
    after = changes.merge(i.lake, i.staging, KEY).result.where(F.col("o_orderkey") % 70 != 0)
    return diff.snapshot_changes(i.lake, publish.materialize(after, scratch_path(spark, "after")), KEY, ranges=RANGES)


def backfill_with_changes(spark, d):
    """Backfill of the lake orders in key-range chunks while change batches arrive; the run is given up
    after three chunks and resumed by another one. Returns the live rows of the copy."""
    root = scratch_path(spark, "backfill")
    i = _Inputs(spark, d)
    parts = fixtures.change_feed_parts(i.staging, 4)

    def feed(n: int, batch_id: int) -> None:
        latest = parts[n].withColumn("op", F.lit(None).cast("string"))
        changelog.ChangeLog.open(spark, root).append(latest, changelog.measure(latest), batch_id)

    log = changelog.start_backfill(spark, root, i.lake, KEY, RANGES)
    feed(1, 0)
    # the source is the lake as it was before the feed, so every change stays above the chunks' mark
    changelog.run_backfill(log, lambda: i.lake, lambda: 0, max_chunks=3)
    feed(2, 1)
    feed(0, 2)
    resumed = changelog.start_backfill(spark, root, i.lake, KEY, RANGES)
    changelog.run_backfill(resumed, lambda: i.lake, lambda: 0)
    feed(3, 3)
    log = changelog.ChangeLog.open(spark, root)
    log.compact(ranges=[0, 1])
    return sync.read_log(spark, root)


def sync_row_counts(spark, d):
    """All eight tables synced by their own keys (composite ones too): a snapshot and a batch of deletes and
    inserts each, published as two cuts; the older cut is left as it was. Rows and key sums by table."""
    root = scratch_path(spark, "group")
    lake = tables.tpch_tables(spark, d, CLONE_TABLES)
    backfill = {n: t.withColumns({"seq": F.lit(0).cast("long"), "op": F.lit(None).cast("string")}) for n, t in lake.items()}
    changelog.apply_to_group(spark, root, backfill, TPCH_KEYS, 0)
    batches = {n: fixtures.key_changes(t, TPCH_KEYS[n]) for n, t in lake.items()}
    changelog.apply_to_group(spark, root, batches, TPCH_KEYS, 1)
    changelog.apply_to_group(spark, root, batches, TPCH_KEYS, 1)               # replay: nothing is applied twice
    counted = []
    for n, log in sorted(changelog.open_group(spark, root).items()):
        live = sync.live_rows(log.read())
        counted.append(live.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(TPCH_KEYS[n][0]), F.lit(0)).cast("long").alias("key_sum"))
                       .select(F.lit(n).alias("table_name"), "n_rows", "key_sum"))
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out


def page_synced_customers(spark, d):
    """A page of customers from the synced copy, not from the lake: snapshot, then changes by key."""
    root = scratch_path(spark, "customers")
    cust = tables.read_table(spark, d, "customer")
    first = cust.withColumns({"seq": F.lit(0).cast("long"), "op": F.lit(None).cast("string")})
    key = TPCH_KEYS["customer"]
    log = changelog.create_from(spark, root, first, key, RANGES)
    batch = fixtures.key_changes(cust, key)
    log.append(batch, changelog.measure(batch))
    return query.page(sync.read_log(spark, root), "c_custkey", CUSTOMER_VIEW_COLUMNS, CUSTOMER_LIMIT, CUSTOMER_OFFSET)


def page_ranked(spark, d):
    """A deep page of the live orders of a change-file copy, from the ranges that the row counts point to: a snapshot
    and a batch of changes, of which only the touched ranges are counted again."""
    root = scratch_path(spark, "ranked")
    i = _Inputs(spark, d)
    first = i.lake.withColumns({"seq": F.lit(0).cast("long"), "op": F.lit(None).cast("string")})
    log = changelog.create_from(spark, root, first, KEY, RANGES)
    index = rank_index.RankIndex(spark, root)
    index.refresh()
    batch = i.staging.withColumns({"seq": F.lit(1).cast("long"), "op": F.lit(None).cast("string")})
    log.append(batch, changelog.measure(batch))
    return index.page(PAGE_LIMIT, RANKED_OFFSET).rows


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "snapshot_clone": snapshot_clone,
    "clone_row_counts": clone_row_counts,
    "staging_scan": staging_scan,
    "typed_staging": typed_staging,
    "seed_candidates": seed_candidates,
    "ingest_accept": ingest_accept,
    "ingest_reject_counts": ingest_reject_counts,
    "ingest_new_order_reject_counts": ingest_new_order_reject_counts,
    "search_text": search_text,
    "search_text_indexed": search_text_indexed,
    "count_search_indexed": count_search_indexed,
    "search_empty_term": search_empty_term,
    "get_by_key": get_by_key,
    "get_by_keys": get_by_keys,
    "missing_keys": missing_keys,
    "count_all": count_all,
    "count_search": count_search,
    "page_stats": page_stats,
    "page_orders": page_orders,
    "page_search": page_search,
    "page_deep": page_deep,
    "page_customers": page_customers,
    "page_keyset": page_keyset,
    "page_ranked": page_ranked,
    "merge_orders": merge_orders,
    "merge_match_classes": merge_match_classes,
    "merge_metrics": merge_metrics,
    "merge_twice": merge_twice,
    "merge_shuffle": merge_shuffle,
    "merge_latest": merge_latest,
    "merge_split": merge_split,
    "forward_merge": forward_merge,
    "forward_merge_buckets": forward_merge_buckets,
    "forward_with_bad_rows": forward_with_bad_rows,
    "forward_rejects": forward_rejects,
    "forward_metrics": forward_metrics,
    "forward_incremental": forward_incremental,
    "forward_incremental_buckets": forward_incremental_buckets,
    "forward_incremental_metrics": forward_incremental_metrics,
    "insert_strict": insert_strict,
    "insert_conflicts": insert_conflicts,
    "insert_sketched": insert_sketched,
    "insert_sketched_conflicts": insert_sketched_conflicts,
    "insert_returning": insert_returning,
    "patch_returning": patch_returning,
    "json_out": json_out,
    "missing_table_page": missing_table_page,
    "delete_from_lake": delete_from_lake,
    "patch_update": patch_update,
    "patch_outcomes": patch_outcomes,
    "delete_by_key": delete_by_key,
    "delete_outcomes": delete_outcomes,
    "seed_new_rows": seed_new_rows,
    "seed_counts": seed_counts,
    "seed_result": seed_result,
    "fill_defaults": fill_defaults,
    "key_violations": key_violations,
    "key_violation_summary": key_violation_summary,
    "staging_key_violations": staging_key_violations,
    "length_violations": length_violations,
    "sync_final_state": sync_final_state,
    "sync_final_state_buckets": sync_final_state_buckets,
    "sync_two_checkpoints": sync_two_checkpoints,
    "sync_final_state_log": sync_final_state_log,
    "snapshot_changes": snapshot_changes,
    "backfill_with_changes": backfill_with_changes,
    "sync_row_counts": sync_row_counts,
    "page_synced_customers": page_synced_customers,
}
