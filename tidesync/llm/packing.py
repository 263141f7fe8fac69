"""Best-fit packing of documents into bins of fixed capacity, with conflicts.

Method: documents are dealt by a hash of their id to shards of bounded size, and each shard is packed
by best fit, largest piece first. Bins are ordered by their residual; a bin carries bitmaps of the
sources and of the duplicate clusters it holds. The successor search starts at the smallest residual
that fits the piece and goes on to the next larger one until it finds the tightest bin without a
conflict; if there is none, a new bin is opened.

Conflicts: a bin holds no two pieces of one duplicate cluster, and at most ``per_source`` pieces of
one source (one bitmap per allowed repeat). A document longer than the capacity is cut into full
pieces and a rest; only sizes travel, never texts.

Shards are hash-dealt, so a hot source or cluster is spread evenly over them, and rows that repeat id and text
are numbered first, so they are, too. The number of shards grows
with the rows and words; one task never sees more than about ``shard_rows`` rows. The search visits a
residual only if some bin has it.

Cases: a document without words takes no bin and gives no row. A null source conflicts with nothing.
Rows that repeat an id are separate documents of one cluster.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidesync.llm.common import count_words, numbered_copies, pinned, text_of
from tidesync.llm.exact_dedup import normalised

CAPACITY = 2048
PER_SOURCE = 4
SHARD_ROWS = 8192
SHARD_PIECES = 16384


class Bins:
    """Bins of one shard, ordered by residual."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.levels: list[dict[tuple, list[int]]] = [{} for _ in range(capacity + 1)]
        self.present = 0  # bit r is set if a bin has residual r
        self.used: list[int] = []

    def _fits(self, state: tuple, source: int, cluster: int) -> bool:
        *sources, clusters = state
        return not (clusters & cluster) and not (source and all(s & source for s in sources))

    def _move(self, state: tuple, source: int, cluster: int) -> tuple:
        *sources, clusters = state
        for i, held in enumerate(sources):
            if source and not held & source:
                sources[i] = held | source
                break
        return (*sources, clusters | cluster)

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Put a piece into the tightest compatible bin: (bin, offset)."""
        ahead = self.present >> size
        base = size
        while ahead:
            step = (ahead & -ahead).bit_length() - 1
            residual = base + step
            level = self.levels[residual]
            state = next((s for s in level if self._fits(s, source, cluster)), None)
            if state is not None:
                number = level[state].pop()
                if not level[state]:
                    del level[state]
                if not level:
                    self.present &= ~(1 << residual)
                return self._fill(number, residual, state, size, source, cluster)
            ahead >>= step + 1
            base = residual + 1
        self.used.append(0)
        empty = (0,) * (self.per_source + 1)
        return self._fill(len(self.used) - 1, self.capacity, empty, size, source, cluster)

    def _fill(self, number: int, residual: int, state: tuple, size: int, source: int, cluster: int) -> tuple[int, int]:
        offset, left = self.used[number], residual - size
        self.used[number] += size
        if left:
            self.levels[left].setdefault(self._move(state, source, cluster), []).append(number)
            self.present |= 1 << left
        return number, offset


def pack_shard(pieces: pd.DataFrame, capacity: int, per_source: int) -> pd.DataFrame:
    """Best fit, largest first; ties by id and piece, so reruns agree."""
    rows = pieces.sort_values(["n_words", "doc_id", "piece", "copy"], ascending=[False, True, True, True], kind="stable", na_position="last")
    sources, clusters, placed = {}, {}, []
    bins = Bins(capacity, per_source)
    for size, source, cluster in zip(rows["n_words"], rows["source"], rows["cluster"]):
        s = 0 if source is None else 1 << sources.setdefault(source, len(sources))
        c = 1 << clusters.setdefault(cluster, len(clusters))
        placed.append(bins.place(int(size), s, c))
    return rows.assign(bin=[p[0] for p in placed], offset=[p[1] for p in placed])


def pack(
    spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE,
    shard_rows: int = SHARD_ROWS, shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """One row per piece: doc_id, piece, n_words, source, shard, bin, offset."""
    sizes = docs.select(
        "doc_id", "source", count_words(text_of()).alias("size"), F.xxhash64(normalised(text_of())).alias("cluster")
    ).filter("size > 0")
    sizes = pinned(spark, numbered_copies(sizes, "copy"), "pack-sizes")
    total = sizes.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.ceil(F.col("size") / capacity)), F.lit(0)).alias("pieces")).first()
    shards = max(1, -(-total["rows"] // shard_rows), -(-int(total["pieces"]) // shard_pieces))
    pieces = (
        sizes.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / capacity) - 1)))
        .withColumn("n_words", F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("piece") * capacity))
        .withColumn("shard", F.pmod(F.xxhash64(F.lit(29), "doc_id", "piece", "cluster", "source", "copy"), F.lit(shards)).cast("long"))
        .select("doc_id", "piece", "n_words", "source", "cluster", "copy", "shard")
    )

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(source=[None if pd.isna(s) else s for s in rows["source"]])
        return pack_shard(rows, capacity, per_source).drop(columns=["cluster", "copy"])

    schema = "doc_id long, piece long, n_words long, source string, shard long, bin long, offset long"
    return pieces.groupBy("shard").applyInPandas(packed, schema)
