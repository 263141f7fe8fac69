"""Change-file layout, snapshot diff, resumable backfill and groups of tables."""

import datetime as dt
import glob
import os
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helpers import order, orders_df
from test_sync import COLS, KEY, with_meta
from tidesync.operators import changes, diff, ranges
from tidesync.operators.sizing import measure
from tidesync.plans import changelog, versions
from tidesync.session import local_path, scratch_path
from tidesync.sources import fixtures, tables
from tidesync.streaming import sync

SF = "/root/testdata/sf0.001"


def status(df):
    return {r["o_orderkey"]: r["o_orderstatus"] for r in df.collect()}


def run_log_sync(spark, parts, max_files, compact_parts=2):
    root = scratch_path(spark, "t-log")
    for p in parts:
        p.select(*COLS).coalesce(1).write.mode("append").parquet(f"{root}/feed")
    schema = spark.read.parquet(f"{root}/feed").schema
    q = sync.sync_files(spark, f"{root}/feed", schema, "unused", f"{root}/table", KEY, f"{root}/ckpt",
                        max_files_per_trigger=max_files, layout="log", ranges=4, compact_parts=compact_parts)
    q.awaitTermination()
    assert q.exception() is None
    return f"{root}/table", schema


def log_of(spark, rows, seq=0, ranges=4):
    root = scratch_path(spark, "t-log")
    return changelog.create_from(spark, root, with_meta(orders_df(spark, rows), seq), KEY, ranges)


def append(log, rows, seq, op=None, batch_id=None, stream=None):
    df = with_meta(orders_df(log.spark, rows), seq, op)
    return log.append(df, measure(df), batch_id, stream)


def folder_bytes(path):
    return sum(os.path.getsize(f) for f in glob.glob(local_path(path) + "/**/*.parquet", recursive=True))


# ---- change-file layout ------------------------------------------------------------------------------


@pytest.mark.parametrize("max_files, compact_parts", [(1, 2), (1, 99), (10, 2)])
def test_log_stream_equals_batch(spark, max_files, compact_parts):
    lake = tables.lake_orders(spark, SF)
    staged = fixtures.staging(lake)
    parts = [with_meta(lake, 0)] + [p.withColumn("op", F.lit(None).cast("string"))
                                    for p in fixtures.change_feed_parts(staged, 4)[::-1]]
    root, _ = run_log_sync(spark, parts, max_files, compact_parts)
    got = sorted(map(tuple, sync.read_log(spark, root).collect()))
    assert got == sorted(map(tuple, changes.merge(lake, staged, KEY).result.collect()))


def test_log_seq_rule_tombstones_and_replay(spark):
    base = with_meta(orders_df(spark, [order(i) for i in range(1, 40)]), 1)
    newer = with_meta(orders_df(spark, [order(1, status="F")]), 5)
    delete = with_meta(orders_df(spark, [order(2)]), 5, "D")
    late_old = with_meta(orders_df(spark, [order(1, status="P"), order(2, status="P")]), 3)
    root, _ = run_log_sync(spark, [base, newer, delete, late_old], 1)
    got = status(sync.read_log(spark, root))
    assert got[1] == "F" and 2 not in got and len(got) == 38
    log = changelog.ChangeLog.open(spark, root)
    last = max(log.state["batches"].values())
    stream = next(iter(log.state["batches"]))
    assert append(log, [order(3, status="X")], 9, batch_id=last, stream=stream) is None        # replay
    assert append(log, [order(3, status="X")], 9, batch_id=last, stream="another") is not None  # another stream
    assert status(sync.read_log(spark, root))[3] == "X"


def test_a_batch_writes_what_it_holds(spark):
    """Bytes of a batch follow the batch: the same ten rows cost the same in a copy 50 times as large."""
    cost = {}
    for n in (200, 10_000):
        log = log_of(spark, [order(i, comment=f"c{i}") for i in range(n)])
        small = append(log, [order(i, status="F") for i in range(10)], 1)
        large = append(log, [order(i, status="F", comment=f"d{i * 7919}") for i in range(0, n, 2)], 2)
        assert log.state["changes"][0]["rows"] == 10
        cost[n] = folder_bytes(small), folder_bytes(large), sum(folder_bytes(p) for p in log.state["base"].values())
    assert cost[10_000][0] <= 1.5 * cost[200][0]
    assert cost[10_000][2] > 10 * cost[10_000][0]                # what a rewritten copy would have cost
    assert cost[10_000][1] > 3 * cost[200][1]


def test_compaction_rewrites_only_the_ranges_with_changes(spark):
    log = log_of(spark, [order(i) for i in range(400)], ranges=4)
    before = dict(log.state["base"])
    append(log, [order(1, status="F"), order(2, status="F")], 1)
    append(log, [order(1, status="P")], 2)
    want = status(log.read())
    assert log.compact(least_parts=3) == []
    assert log.compact(least_parts=2) == [0]
    assert log.state["changes"] == [] and {r for r, p in log.state["base"].items() if before[r] != p} == {"0"}
    assert status(log.read()) == want and want[1] == "P" and want[2] == "F"


def test_changes_appended_during_a_compaction_stay(spark, monkeypatch):
    log = log_of(spark, [order(i) for i in range(100)])
    append(log, [order(1, status="F")], 1)
    plain = changelog.ChangeLog._write

    def slow(self, df, kind):
        path = plain(self, df, kind)
        if kind == "base":
            monkeypatch.setattr(changelog.ChangeLog, "_write", plain)
            append(self.refreshed(), [order(1, status="P"), order(50, status="P")], 2)
        return path

    monkeypatch.setattr(changelog.ChangeLog, "_write", slow)
    log.compact()
    got = status(changelog.ChangeLog.open(spark, log.root).read())
    assert got[1] == "P" and got[50] == "P" and len(got) == 100


def test_old_versions_stay_readable_until_vacuum(spark):
    log = log_of(spark, [order(i) for i in range(100)])
    first = log.version
    append(log, [order(1, status="F")], 1)
    log.compact()
    assert status(changelog.ChangeLog.open(spark, log.root, first).read())[1] == "O"
    assert log.vacuum(keep_versions=1) == []                     # all younger than the grace period
    gone = log.vacuum(keep_versions=1, retain_seconds=-10)
    assert gone and status(changelog.ChangeLog.open(spark, log.root).read())[1] == "F"
    assert versions.numbers(spark, f"{log.root}/versions") == [log.version]


def test_a_lost_first_batch_is_applied_on_replay(spark, monkeypatch):
    root = scratch_path(spark, "t-log")
    writer = sync.sync_batch_writer("unused", root, KEY, layout="log")
    batch = with_meta(orders_df(spark, [order(i) for i in range(30)]), 1)

    def lost(*a, **kw):
        raise RuntimeError("driver lost")

    monkeypatch.setattr(changelog.ChangeLog, "set_base", lost)
    with pytest.raises(RuntimeError):
        writer(batch, 0)
    monkeypatch.undo()
    writer(batch, 0)
    writer(batch, 0)
    assert sync.read_log(spark, root).count() == 30


def test_point_reads_touch_their_range_only(spark):
    log = log_of(spark, [order(i) for i in range(400)], ranges=4)
    append(log, [order(399, status="F"), order(5000)], 1)
    df = log.rows_between(390, 10_000)
    assert sorted(status(df).items())[-2:] == [(399, "F"), (5000, "O")] and df.count() == 11
    assert len(df.inputFiles()) < len(log.read().inputFiles())


def test_unfinished_and_contested_records(spark):
    folder = scratch_path(spark, "t-rec")
    versions.put(spark, folder, 1, {"n": 1})
    with open(local_path(folder) + f"/v-{2:012d}.json", "w") as f:
        f.write('{"n": 2, "unfin')
    assert versions.latest(spark, folder) == (1, {"n": 1})
    with pytest.raises(versions.ConflictError):
        versions.put(spark, folder, 1, {})
    assert versions.update(spark, folder, lambda r: {"n": r["n"] + 10}) == 3
    assert versions.latest(spark, folder) == (3, {"n": 11})


# ---- key ranges ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("dtype, make", [
    (T.LongType(), lambda i: i * 3 - 200),
    (T.StringType(), lambda i: f"ä{i % 37}é{i}"),
    (T.DecimalType(12, 2), lambda i: Decimal(i) / 4),
    (T.DateType(), lambda i: dt.date(1970, 1, 1) + dt.timedelta(days=i * 31 - 900)),
    (T.TimestampType(), lambda i: dt.datetime(1999, 1, 1) + dt.timedelta(hours=i * 7)),
])
def test_ranges_and_their_predicates_agree(spark, dtype, make):
    schema = T.StructType([T.StructField("k", dtype)])
    df = spark.createDataFrame([(make(i),) for i in range(300)] + [(None,)] * 3, schema)
    bounds = ranges.key_bounds(df, ["k"], 8)
    assert len(bounds) == 7
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        numbered = df.withColumn("r", ranges.range_of("k", dtype, bounds))
        sizes = {r["r"]: r["count"] for r in numbered.groupBy("r").count().collect()}
        assert set(sizes) == set(range(8)) and max(sizes.values()) < 90
        for wanted in ([0], [7], [2, 3, 5], [], list(range(8))):
            picked = numbered.where(ranges.in_ranges("k", dtype, bounds, wanted)).select("r").distinct().collect()
            assert {r["r"] for r in picked} == set(wanted)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_bounds_of_empty_and_constant_keys(spark):
    df = spark.createDataFrame([(1,)] * 50, "k int")
    assert ranges.key_bounds(df, ["k"], 8) == [] == ranges.key_bounds(df.limit(0), ["k"], 8)


# ---- snapshot changes --------------------------------------------------------------------------------


def test_snapshot_changes_by_brute_force(spark):
    schema = "a int, b string, v string, w double"
    old = {(i, f"k{i % 3}"): (None if i % 5 == 0 else f"v{i}", i / 2) for i in range(300)}
    old[(None, "n")], old[(None, "m")] = ("x", None), ("y", None)
    new = dict(old)
    new[(7, "k1")] = (None, 3.5)                            # value to NULL
    new[(10, "k1")] = ("", 5.0)                             # NULL to empty
    new[(None, "n")] = ("z", None)
    del new[(20, "k2")], new[(None, "m")]
    new[(9000, "k")] = (None, None)

    def frame(d):
        return spark.createDataFrame([(*k, *v) for k, v in d.items()], schema)

    got = {tuple(r) for r in diff.snapshot_changes(frame(old), frame(new).select("w", "b", "v", "a"), ["a", "b"], ranges=8).select("a", "b", "v", "w", "change").collect()}
    want = {(*k, *new[k], "I") for k in new.keys() - old.keys()} | {(*k, None, None, "D") for k in old.keys() - new.keys()}
    want |= {(*k, *new[k], "U") for k in new.keys() & old.keys() if new[k] != old[k]}
    assert got == want
    assert diff.snapshot_changes(frame(old), frame(old), ["a", "b"]).count() == 0
    assert {r["change"] for r in diff.snapshot_changes(frame(old).limit(0), frame(new), ["a", "b"]).collect()} == {"I"}


def test_nulls_that_swap_columns_are_seen(spark):
    old = spark.createDataFrame([(1, None, "x")], "k int, p string, q string")
    new = spark.createDataFrame([(1, "x", None)], "k int, p string, q string")
    assert [r["change"] for r in diff.snapshot_changes(old, new, ["k"]).collect()] == ["U"]


def test_only_differing_ranges_are_read_again(spark):
    path = scratch_path(spark, "t-diff")
    lake = tables.lake_orders(spark, SF)
    lake.repartitionByRange(8, "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(path)
    old = spark.read.parquet(path)
    bounds = ranges.key_bounds(old, KEY, 8)
    new = old.withColumn("o_orderstatus", F.when(F.col("o_orderkey") == 3, F.lit("Z")).otherwise(F.col("o_orderstatus")))
    kept = diff.range_digests(old, KEY, bounds)
    assert kept.count() <= 8
    assert diff.differing_ranges(kept, diff.range_digests(new, KEY, bounds)) == [0]
    out = diff.snapshot_changes(old, new, KEY, bounds=bounds, old_digests=kept)
    assert [(r["o_orderkey"], r["o_orderstatus"], r["change"]) for r in out.collect()] == [(3, "Z", "U")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert f"LessThan(o_orderkey,{bounds[0]})" in plan


# ---- resumable backfill ------------------------------------------------------------------------------


class Source:
    """A live table and its feed: each change is visible in the table and is given out with a seq."""

    def __init__(self, spark, n):
        self.spark, self.rows, self.seq = spark, {i: order(i) for i in range(n)}, 0
        self.log = None

    def frame(self):
        return orders_df(self.spark, list(self.rows.values()))

    def change(self, k, status, deliver=True):
        self.seq += 1
        if status is None:
            self.rows.pop(k, None)
        else:
            self.rows[k] = order(k, status=status)
        if deliver:
            self.deliver([(k, status, self.seq)])

    def deliver(self, events):
        for k, status, seq in events:
            append(self.log.refreshed(), [order(k, status=status or "O")], seq, None if status else "D", seq)


def test_a_killed_backfill_resumes_and_meets_the_feed(spark):
    src = Source(spark, 200)
    root = scratch_path(spark, "t-back")
    src.log = log = changelog.start_backfill(spark, root, src.frame(), KEY, chunks=5)
    chunks = len(log.state["chunks"])
    src.change(3, "A")                                        # before its chunk
    calls = [0]

    def dies():
        calls[0] += 1
        if calls[0] == 3:
            raise RuntimeError("killed")
        return src.frame()

    with pytest.raises(RuntimeError):
        changelog.run_backfill(log, dies, lambda: src.seq)
    done = [r for r, c in log.refreshed().state["chunks"].items() if c["done"]]
    assert len(done) == 2                                     # chunk 3 was lost, two are kept
    src.change(4, "B")                                        # after its chunk
    src.change(5, None)                                       # deleted after its chunk
    src.change(198, None)                                     # deleted before its chunk
    src.change(197, "C")
    src.change(900, "N")                                      # a new key beyond the last bound
    resumed = changelog.start_backfill(spark, root, src.frame(), KEY, chunks=5)
    reads = []

    def moving():
        reads.append(src.seq)
        frame = src.frame()
        src.change(196, f"{len(reads)}")                      # changes while the chunk is read
        return frame

    assert changelog.run_backfill(resumed, moving, lambda: src.seq) == chunks - 2
    ledger = changelog.ChangeLog.open(spark, root).state["chunks"]
    assert all(c["done"] and c["low"] <= c["high"] for c in ledger.values())
    want = {k: r[2] for k, r in src.rows.items()}
    assert status(sync.read_log(spark, root)) == want
    again = changelog.start_backfill(spark, root, src.frame(), KEY, chunks=5)
    assert changelog.run_backfill(again, src.frame, lambda: src.seq) == 0
    again.compact()
    assert status(sync.read_log(spark, root)) == want


def test_late_and_repeated_deliveries_do_not_undo_a_chunk(spark):
    src = Source(spark, 50)
    root = scratch_path(spark, "t-back")
    src.log = changelog.start_backfill(spark, root, src.frame(), KEY, chunks=3)
    src.change(1, "A", deliver=False)                         # seq 1, still on its way
    src.change(1, "B", deliver=False)                         # seq 2
    changelog.run_backfill(src.log, src.frame, lambda: src.seq)
    src.deliver([(1, "B", 2)])
    src.deliver([(1, "A", 1)])
    assert status(sync.read_log(spark, root))[1] == "B"


def test_compaction_leaves_ranges_without_their_chunk(spark):
    src = Source(spark, 100)
    src.log = log = changelog.start_backfill(spark, scratch_path(spark, "t-back"), src.frame(), KEY, chunks=4)
    src.change(1, "A")
    src.change(99, "B")
    changelog.run_backfill(log, src.frame, lambda: src.seq, max_chunks=1)
    assert log.refreshed().compact() == [0]
    changelog.run_backfill(log.refreshed(), src.frame, lambda: src.seq)
    assert status(sync.read_log(spark, log.root)) == {k: r[2] for k, r in src.rows.items()}


# ---- groups --------------------------------------------------------------------------------------------


def test_a_group_shows_one_cut(spark, monkeypatch):
    root = scratch_path(spark, "t-group")
    keys = {"one": ["k"], "two": ["k", "l"]}
    schema = "k int, l int, v string, seq long, op string"

    def batch(v, seq, rows):
        return spark.createDataFrame([(k, k, v, seq, None) for k in rows], schema)

    changelog.apply_to_group(spark, root, {n: batch("a", 0, range(10)) for n in keys}, keys, 0, ranges=2)
    plain = changelog.ChangeLog.append
    done = []

    def second_fails(self, *a, **kw):
        if done:
            raise RuntimeError("driver lost")
        done.append(1)
        return plain(self, *a, **kw)

    update = {n: batch("b", 1, [1, 11]) for n in keys}
    monkeypatch.setattr(changelog.ChangeLog, "append", second_fails)
    with pytest.raises(RuntimeError):
        changelog.apply_to_group(spark, root, update, keys, 1)
    monkeypatch.undo()

    def seen():
        return {n: sorted((r["k"], r["v"]) for r in log.read().where("v = 'b'").collect()) for n, log in changelog.open_group(spark, root).items()}

    assert seen() == {"one": [], "two": []}                  # one table has the batch, the cut has not
    changelog.apply_to_group(spark, root, update, keys, 1)
    assert seen() == {"one": [(1, "b"), (11, "b")], "two": [(1, "b"), (11, "b")]}
    assert {len(log.state["changes"]) for log in changelog.open_group(spark, root).values()} == {1}
    assert [log.read().count() for log in changelog.open_group(spark, root, 1).values()] == [10, 10]


@pytest.mark.parametrize("repeats", [1, 5000])
def test_key_bounds_sample_is_cut_before_the_top_k(spark, monkeypatch, repeats):
    monkeypatch.setattr(ranges, "SAMPLE_KEYS", 200)
    df = spark.range(0, 20_000, 1, 16).select((F.col("id") / repeats).cast("long").alias("k"))
    every = df.select(F.col("k").alias("v"), F.xxhash64("k").alias("h")).orderBy("h", "v").limit(200).collect()
    values = sorted(r["v"] for r in every)
    wanted = sorted({values[len(values) * i // 8] for i in range(1, 8)})
    asked = []
    taken = type(df).limit

    def limit(self, n):
        asked.append(self.count())
        return taken(self, n)

    monkeypatch.setattr(type(df), "limit", limit)
    assert ranges.key_bounds(df, ["k"], 8) == [str(v) for v in wanted if v != values[0]]
    # what the top-k is taken from, and may send from every task, follows the sample and not the table
    assert asked and max(asked) <= 1000
