"""Key sketches, rank index, split merge, counts from committed files."""

import random
import uuid

import pytest
from helpers import by_key, order, orders_df
from pyspark.sql import functions as F

from tidesync.operators import changes, query
from tidesync.plans import bucketed, changelog, forward, key_sketch, publish, rank_index
from tidesync.session import scratch_path

KEY = ["o_orderkey"]


def sketched(spark, rows, buckets=8):
    root = scratch_path(spark, "t-sketch")
    table = bucketed.create(spark, "t_sketch_" + uuid.uuid4().hex[:8], rows, KEY, buckets, root)
    sketch = key_sketch.KeySketch(spark, table, f"{root}/sketches")
    assert sketch.refresh() == sorted(bucketed.partition_locations(spark, table.name))
    return table, sketch


def keys_df(spark, keys, dtype="bigint"):
    return spark.createDataFrame([(k,) for k in keys], "o_orderkey bigint").select(F.col("o_orderkey").cast(dtype))


def test_sketch_never_says_absent_of_a_key_that_is_there(spark):
    rng = random.Random(3)
    held = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(4000)] + [0, -1, (1 << 63) - 1, -(1 << 63)]
    table, sketch = sketched(spark, keys_df(spark, held))
    bucket = bucketed.bucket_of(KEY, 8, table.key_types)
    where = {r["o_orderkey"]: r["b"] for r in keys_df(spark, held).select("o_orderkey", bucket.alias("b")).collect()}
    for part in (held[:1], held[7:9], held[-4:], held):
        assert {where[k] for k in part} <= set(sketch.buckets_that_may_hold(keys_df(spark, part)))
    # the same keys in another type
    assert set(sketch.buckets_that_may_hold(keys_df(spark, [held[5]], "decimal(20,0)"))) >= {where[held[5]]}


def test_sketch_leaves_out_buckets_of_new_keys(spark):
    table, sketch = sketched(spark, keys_df(spark, range(20_000)), 32)
    new = keys_df(spark, range(1_000_000, 1_000_200))
    assert len(bucketed.touched_buckets(new, table)) == 32
    read = sketch.buckets_that_may_hold(new)
    assert len(read) <= 12                                   # 200 new keys at about 1 in 100
    alone = [len(sketch.buckets_that_may_hold(keys_df(spark, [k]))) for k in (2_000_000, 2_000_001, 2_000_002)]
    assert sum(alone) <= 1
    assert sketch.buckets_that_may_hold(keys_df(spark, [17])) == bucketed.touched_buckets(keys_df(spark, [17]), table)


def test_sketched_insert_equals_plain_insert_and_outdated_sketches_are_not_trusted(spark):
    rows = orders_df(spark, [order(k) for k in range(500)])
    table, sketch = sketched(spark, rows)
    batch = orders_df(spark, [order(k) for k in (3, 499, 700, 701, 702, 702)])
    plain = changes.insert_strict(table.read(spark), batch, KEY)
    pin = lambda df: publish.materialize(df, scratch_path(spark, "t-judged"))
    done = sketch.insert_strict(batch, pin=pin)
    assert by_key(done.insert.inserted) == by_key(plain.inserted) and set(by_key(plain.inserted)) == {700, 701}
    assert sorted(map(tuple, done.insert.conflicts.collect())) == sorted(map(tuple, plain.conflicts.collect()))
    touched = key_sketch.publish_inserts(spark, table, done.insert.inserted)
    assert table.read(spark).count() == 502
    again = sketch.insert_strict(orders_df(spark, [order(700), order(701), order(900)]), pin=pin)   # sketches are outdated
    assert set(by_key(again.insert.inserted)) == {900} and set(touched) <= set(again.buckets_read) | set(touched)
    assert sketch.refresh() == touched                        # only what changed is read again
    assert sketch.refresh() == []
    assert set(by_key(sketch.insert_strict(batch, pin=pin).insert.inserted)) == set()


def test_sketch_with_empty_batch_null_and_text_keys(spark):
    rows = spark.createDataFrame([("a", 1), ("bé", 2), ("", 3), (None, 4)], "o_orderkey string, v int")
    table, sketch = sketched(spark, rows)
    assert sketch.buckets_that_may_hold(rows.limit(0)) == []
    assert sketch.buckets_that_may_hold(rows.where("o_orderkey IS NULL")) == []
    target, buckets = sketch.target_for(rows.where("o_orderkey IS NOT NULL"))
    assert {"a", "bé", ""} <= {r["o_orderkey"] for r in target.collect()} and buckets
    assert sketch.target_for(rows.limit(0))[0].count() == 0


def ranked(spark, keys, ranges=5, dtype="bigint"):
    root = scratch_path(spark, "t-ranks")
    first = keys_df(spark, keys, dtype).withColumns({"v": F.lit("x"), "seq": F.lit(0).cast("long"), "op": F.lit(None).cast("string")})
    return changelog.create_from(spark, root, first, KEY, ranges), rank_index.RankIndex(spark, root)


def batch(spark, rows):
    return spark.createDataFrame(rows, "o_orderkey bigint, v string, seq bigint, op string")


def test_ranked_page_equals_page_and_reads_one_range(spark):
    log, index = ranked(spark, range(0, 2000, 2))
    live = lambda: index.live(changelog.ChangeLog.open(spark, index.root), log.ranges)
    for limit, offset in ((10, 0), (10, 7), (5, 503), (10, 995), (10, 1000), (0, 3), (10, 5000)):
        got = index.page(limit, offset)
        assert got.rows.collect() == query.page(live(), KEY, None, limit, offset).collect()
        assert len(got.ranges_read) <= 2
    assert len(index.page(5, 503).ranges_read) == 1 and index.page(10, 5000).ranges_read == []
    # changes: two deletes and an insert in the first range, one update in the last; only these are counted again
    changed = batch(spark, [(0, "x", 1, "D"), (4, "x", 1, "D"), (5, "new", 1, None), (1998, "upd", 1, None)])
    log.append(changed, changelog.measure(changed))
    counts, counted = index.refresh()
    assert counted == [0, 4] and sum(counts) == 999 == live().count()
    assert index.refresh()[1] == []
    for limit, offset in ((10, 0), (10, 195), (5, 994)):
        assert index.page(limit, offset).rows.collect() == query.page(live(), KEY, None, limit, offset).collect()
    changelog.ChangeLog.open(spark, index.root).compact()
    assert index.page(3, 996, ["v"]).rows.collect() == query.page(live(), KEY, ["v"], 3, 996).collect()
    assert index.page(10, 900, max_rest=20).rows.collect() == query.page(live(), KEY, None, 10, 900).collect()


def test_ranked_page_of_empty_and_null_keys(spark):
    _, index = ranked(spark, [])
    assert index.page(10, 0).rows.collect() == [] and index.page(10, 0).ranges_read == []
    with pytest.raises(ValueError):
        index.page(-1, 0)
    log, index = ranked(spark, [None, *range(50)])
    assert index.page(2, 0, ["o_orderkey"]).rows.collect() == [(None,), (0,)]
    assert index.page(2, 50, ["o_orderkey"]).rows.collect() == [(49,)]


SKEW = "k bigint, part int, v string, s bigint"


@pytest.mark.parametrize("options", [{}, {"newer_than": "s"}, {"delete_missing": True}])
def test_split_merge_equals_the_shuffle_plan(spark, options):
    """A third of the target on one key, another third with none."""
    rows = [(1 if i % 3 == 0 else None if i % 3 == 1 else i, i, "old", i % 5) for i in range(600)]
    target = spark.createDataFrame(rows, SKEW)
    source = spark.createDataFrame([(1, "one", 3), (2, "two", 3), (5, None, 3), (9999, "new", 3), (None, "none", 3)], "k bigint, v string, s bigint")
    plain = changes.merge(target, source, ["k"], strategy="shuffle", observe=True, **options)
    split = changes.merge(target, source, ["k"], strategy="shuffle", observe=True, heavy_rows=50, **options)
    assert (plain.strategy, split.strategy) == ("shuffle", "split")
    as_rows = lambda df: sorted(map(repr, df.collect()))
    assert as_rows(split.result) == as_rows(plain.result)
    assert as_rows(split.classes) == as_rows(plain.classes)
    assert split.observed_metrics() == plain.observed_metrics()
    if options.get("delete_missing"):
        assert as_rows(split.deleted) == as_rows(plain.deleted)


def test_split_merge_without_heavy_keys_and_their_bound(spark):
    target = spark.createDataFrame([(i % 40, i, "old", 0) for i in range(400)], SKEW)
    source = spark.createDataFrame([(1, "one")], "k bigint, v string")
    assert changes.merge(target, source, ["k"], strategy="shuffle", heavy_rows=11).strategy == "shuffle"
    assert changes.heavy_keys(target, ["k"], 10).count() == 40
    many = spark.range(3 * changes.MOST_HEAVY).select((F.col("id") % (changes.MOST_HEAVY + 500)).alias("k"))
    assert changes.heavy_keys(many, ["k"], 1) is None         # 2 rows a key at most, 3 are needed


def test_bucket_metrics_come_from_committed_files(spark):
    """Equal to the per-key classes, with no accumulator in the plan of the write."""
    root = scratch_path(spark, "t-counts")
    current = orders_df(spark, [order(k) for k in range(300)])
    staging = orders_df(spark, [order(k, cust=2) for k in range(250, 330)])
    table = bucketed.create(spark, "t_counts_" + uuid.uuid4().hex[:8], current, KEY, 8, root)
    want = changes.merge(current, staging, KEY).metrics().first().asDict()
    run = forward.forward_merge_buckets(spark, staging, table)
    assert {k: run.metrics[k] for k in want} == want == {
        "num_affected_rows": 80, "num_updated_rows": 50, "num_deleted_rows": 0, "num_inserted_rows": 30}
    again = forward.forward_merge_buckets(spark, staging, table)
    assert again.metrics["num_inserted_rows"] == 0 and again.metrics["num_updated_rows"] == 80
