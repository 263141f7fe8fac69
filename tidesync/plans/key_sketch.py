"""Key sketches of a bucketed table: a Bloom filter per bucket, so a batch of new keys reads few buckets.

An insert has to know which of its keys exist. Without an index the key column of every bucket that a key
hashes to is read, which for a batch of any size is the whole table. The sketch answers "not there" for
nearly all new keys; only buckets that hold a key which may be there are read, and the exact key join runs on them.

The filter is blocked: a key sets ``BITS`` bits of one 64-bit word of its bucket. Building it is therefore one
row per key and one ``bit_or`` per word, with partial results before the shuffle, and asking it one
equi-join on (bucket, word). Sketches are Parquet files sorted by bucket and word, so the buckets of a batch
are found by row-group statistics. The driver gets bucket numbers and folder names, never keys.

A numbered record names, per bucket, the folder that its sketch was made from. A bucket whose folder has changed
since (a batch rewrote it) counts as "may hold anything" until ``refresh`` has read its keys again, so an outdated
sketch costs reads and never a false "not there". NULL keys match nothing and are never asked for.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidesync.operators.changes import InsertResult, insert_strict
from tidesync.operators.sizing import fits_broadcast, hinted, key_size, measure
from tidesync.plans import bucketed, versions
from tidesync.plans.bucketed import BUCKET, BucketedTable

#: Sketch bits per key and bits that a key sets: about one new key in 100 is taken for one that may be there.
BITS_PER_KEY = 16
BITS = 5
SKETCH_SCHEMA = f"{BUCKET} int, word long, mask long"
_WORD_SEED, _MASK_SEED = 1, 2


def _typed_key(table: BucketedTable) -> list[Column]:
    return [F.col(k).cast(t) for k, t in zip(table.key, table.key_types)]


def _mask(key: list[Column]) -> Column:
    """BITS positions of a 64-bit word (they may coincide), from six bits each of one hash."""
    h, mask = F.xxhash64(F.lit(_MASK_SEED), *key), None
    for i in range(BITS):
        position = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), position)
        mask = bit if mask is None else mask.bitwiseOR(bit)
    return mask


def _cells(keys: DataFrame, table: BucketedTable, words: DataFrame) -> DataFrame:
    """``keys`` (with BUCKET) and the word and mask of each; ``words`` has the number of words per bucket."""
    key = _typed_key(table)
    word = F.pmod(F.xxhash64(F.lit(_WORD_SEED), *key), F.col("words")).alias("word")
    return keys.join(F.broadcast(words), BUCKET).select(*keys.columns, word, _mask(key).alias("mask"))


@dataclass
class SketchedInsert:
    insert: InsertResult         # against the buckets that were read; ``inserted`` and ``conflicts`` hold for the table
    buckets_read: list[int]


@dataclass
class KeySketch:
    spark: SparkSession
    table: BucketedTable
    root: str                    # folder of the sketches

    def _record(self) -> dict:
        found = versions.latest(self.spark, f"{self.root}/versions")
        return found[1] if found else {"buckets": {}}

    def _current(self) -> dict[int, dict]:
        """Bucket → its entry, for buckets whose sketch belongs to the folder that they have now."""
        entries = self._record()["buckets"]
        folders = bucketed.partition_locations(self.spark, self.table.name)
        return {b: entries[str(b)] for b, f in folders.items() if entries.get(str(b), {}).get("folder") == f}

    def _words(self, words: dict[int, int]) -> DataFrame:
        """At most one row per bucket."""
        return self.spark.createDataFrame(sorted(words.items()), f"{BUCKET} int, words long")

    def refresh(self) -> list[int]:
        """Sketch the buckets that changed since the last call; returns them. Only their key columns are read."""
        folders = bucketed.partition_locations(self.spark, self.table.name)
        entries = self._record()["buckets"]
        stale = sorted(b for b, f in folders.items() if entries.get(str(b), {}).get("folder") != f)
        if stale:
            keys = self.spark.table(self.table.name).where(F.col(BUCKET).isin(stale)).select(BUCKET, *self.table.key)
            counts = {r[BUCKET]: r["n"] for r in keys.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n")).collect()}
            words = {b: max(1, -(-counts.get(b, 0) * BITS_PER_KEY // 64)) for b in stale}
            path = f"{self.root}/sketch-{uuid.uuid4().hex[:12]}"
            rows = _cells(keys, self.table, self._words(words)).groupBy(BUCKET, "word").agg(F.bit_or("mask").alias("mask"))
            rows = rows.repartitionByRange(BUCKET, "word").sortWithinPartitions(BUCKET, "word")
            rows.write.parquet(path)
            new = {str(b): {"folder": folders[b], "path": path, "words": words[b]} for b in stale}
            versions.update(self.spark, f"{self.root}/versions", lambda old: {"buckets": {**(old or {"buckets": {}})["buckets"], **new}})
        return stale

    def _sketched(self, current: dict[int, dict], buckets: Iterable[int]) -> DataFrame:
        """Sketch rows of some buckets, each from the folder that its entry names."""
        by_path: dict[str, list[int]] = {}
        for b in buckets:
            by_path.setdefault(current[b]["path"], []).append(b)
        out = self.spark.createDataFrame([], SKETCH_SCHEMA)
        for path, held in sorted(by_path.items()):
            out = out.union(self.spark.read.schema(SKETCH_SCHEMA).parquet(path).where(F.col(BUCKET).isin(held)))
        return out

    def buckets_that_may_hold(self, batch: DataFrame) -> list[int]:
        """Buckets that may hold a key of ``batch``; all others hold none of its keys."""
        key = list(self.table.key)
        some = batch.select(*key).dropna()
        some = some.withColumn(BUCKET, bucketed.bucket_of(key, self.table.buckets, self.table.key_types)).distinct()
        touched = {r[BUCKET] for r in some.select(BUCKET).distinct().collect()}
        current = self._current()
        exists = touched & set(bucketed.partition_locations(self.spark, self.table.name))
        known = sorted(exists & set(current))
        sure = exists - set(known)                              # no sketch for their present folder
        if known:
            words = self._words({b: current[b]["words"] for b in known})
            asked = _cells(some, self.table, words).select(BUCKET, "word", F.col("mask").alias("asked"))
            small = fits_broadcast(self.spark, key_size(measure(some), 3))
            hit = self._sketched(current, known).join(hinted(asked, small), [BUCKET, "word"])
            hit = hit.where(F.col("mask").bitwiseAND(F.col("asked")) == F.col("asked"))
            sure |= {r[BUCKET] for r in hit.select(BUCKET).distinct().collect()}
        return sorted(sure)

    def target_for(self, batch: DataFrame) -> tuple[DataFrame, list[int]]:
        """The rows of the buckets that may hold a key of ``batch``, and these buckets. Key joins of the batch
        against them have the same matches as against the whole table."""
        buckets = self.buckets_that_may_hold(batch)
        rows = self.spark.table(self.table.name)
        rows = rows.where(F.col(BUCKET).isin(buckets)) if buckets else rows.limit(0)
        return rows.drop(BUCKET), buckets

    def insert_strict(self, batch: DataFrame, **options) -> SketchedInsert:
        """``operators.changes.insert_strict`` against the buckets that may hold a key of the batch."""
        target, buckets = self.target_for(batch)
        return SketchedInsert(insert_strict(target, batch, list(self.table.key), **options), buckets)


def publish_inserts(spark: SparkSession, table: BucketedTable, inserted: DataFrame) -> list[int]:
    """Add rows with new keys (materialised; see ``pin``) to their buckets; returns the buckets."""
    return bucketed.apply(spark, table, inserted, lambda current, rows: current.unionByName(rows))
