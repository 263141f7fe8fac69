"""Mixing sources to target weights by weighted fair queueing.

Method: every source is shuffled by a keyed hash of the document id and may be read up to
``max_passes`` times. A pass over a document has a virtual start and finish time: the source's words
queued before and after it, divided by the source's target. All sources together emit
``sum(targets)`` words in one unit of virtual time, so the budget ends at virtual time
``budget / sum(targets)``. The pass that is on its way then is queued in pieces: the words sent, the word on its
way (it finishes with the budget, those with the smallest part owed first) and the rest. The pieces are range-sorted by finish time over the
whole corpus, which is the reading order of the mix, and the order is cut at the budget: a piece is taken if
the words before it leave room, the one at the cut is truncated to the words that fit, later ones are cut.
A source's taken words differ from its target by less than one. Passes that start well after the end are not sorted.

The running word count of a source is a two-level prefix sum: the hash order is cut into cells
(as many as the number of rows asks for), a window runs over the cell sums, and a window runs
within each cell. A source with a third of all rows is thus spread over many tasks. So is the running word count of
the sorted order, whose cells are the ranges of the sort. Rows that repeat id, source and size are numbered, and the
number is part of their place.

Targets: weights 5, 2, 1 repeat over the sources in code-point order, null last. A target stops at
``max_passes`` times its source's size and the excess is shared again by weight, until none is above.

Cases: a document without words has size 0 and takes 0; a source without words has target 0. Rows
that repeat an id are separate documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidesync.llm.common import count_words, numbered_copies, pinned, text_of

# Weights by source, repeating, and the number of times a source may be read.
WEIGHTS = (5, 2, 1)
MAX_PASSES = 3


def source_targets(sizes: DataFrame, max_passes: int = MAX_PASSES, weights: tuple = WEIGHTS) -> DataFrame:
    """One row per source: source, source_size, target. ``sizes`` has one row per source and cell.

    Capped sources are those with the smallest ``cap / weight``; with k of them capped, the rest
    share the remaining words by weight. The level is the first one that caps no further source.
    """
    sources = sizes.groupBy("source").agg(F.sum("cell_size").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("weight", F.get(weight, place.cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(max_passes)))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    everything = Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / F.sum("weight").over(after)
    fits = F.when(level * F.col("weight") <= F.col("cap"), F.struct(F.row_number().over(by_cap).alias("k"), level.alias("v")))
    levelled = ranked.withColumn("level", fits)
    final = F.min("level").over(everything)["v"]
    return levelled.select(
        "source", "source_size", F.least(F.col("cap"), F.coalesce(final, F.lit(0.0)) * F.col("weight")).alias("target")
    )


def virtual_times(
    spark: SparkSession, docs: DataFrame, seed: int = 17, max_passes: int = MAX_PASSES, cell_rows: int = 4096
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, queued (words of its source before it)."""
    rows = pinned(
        spark,
        numbered_copies(docs.select("doc_id", "source", count_words(text_of()).alias("size")), "copy").withColumn(
            "place", F.xxhash64(F.lit(seed), "doc_id", "source", "size", "copy")
        ),
        "mix-sizes",
    )
    cells = max(1, -(-rows.count() // cell_rows))
    rows = rows.withColumn("cell", F.shiftright(F.shiftrightunsigned("place", 33) * F.lit(cells), 31))
    sums = pinned(spark, rows.groupBy("source", "cell").agg(F.sum("size").alias("cell_size")), "mix-cells")
    in_source = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("cell_start", F.coalesce(F.sum("cell_size").over(in_source), F.lit(0)))
    targets = source_targets(sums, max_passes)
    starts = pinned(
        spark,
        starts.alias("c").join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source")))
        .select("c.source", "cell", "cell_start", "source_size", "target"),
        "mix-starts",
    )
    in_cell = Window.partitionBy("source", "cell").orderBy("place", F.asc_nulls_last("doc_id"), "size", "copy")
    placed = rows.withColumn(
        "in_cell", F.sum("size").over(in_cell.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    )
    return (
        placed.alias("d")
        .join(starts.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.cell") == F.col("s.cell")))
        .select("doc_id", "d.source", "size", "source_size", "target", (F.col("cell_start") + F.col("in_cell")).alias("queued"))
    )


# Reading order of the mix; two pieces never agree in all of these.
ORDER = ("finish", "owed", "source", "doc_id", "pass", "queued")
MARGIN = 1.01  # no piece that starts later than this share of the budget's end is reached


def mix_pieces(spark: SparkSession, times: DataFrame, budget_share: float = 1.0, max_passes: int = MAX_PASSES) -> DataFrame:
    """The mix: a row per taken piece with pass, start, finish, taken words and ``range``, its range of the sort.

    ``budget_share``: the total budget as a share (up to 1) of all words (the targets sum to all words).
    """
    if not 0 <= budget_share <= 1:
        raise ValueError("budget_share must be from 0 to 1")
    end = F.lit(float(budget_share))
    passes = (
        times.filter("size > 0 AND target > 0")
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(max_passes - 1))))
        .withColumn("place", F.col("queued"))
        .withColumn("queued", F.col("queued") + F.col("pass") * F.col("source_size"))
        .filter(F.col("queued") <= F.col("target") * end * MARGIN)
    )
    whole = F.floor(F.col("target") * end).cast("long")  # words of the source sent by the end; the next one may be on its way
    sent, begun = (F.least(F.greatest(whole + n - F.col("queued"), F.lit(0)), "size") for n in (0, 1))
    cuts = [(F.lit(0).cast("long"), sent), (sent, begun), (begun, F.col("size"))]
    pieces = (
        passes.withColumn("piece", F.explode(F.array(*[F.struct(lo.alias("skip"), (hi - lo).alias("words")) for lo, hi in cuts])))
        .withColumn("words", F.col("piece.words"))
        .filter("words > 0")
        .withColumn("queued", F.col("queued") + F.col("piece.skip"))
        .withColumn("start", F.col("queued") / F.col("target"))
        .withColumn("finish", (F.col("queued") + F.col("words")) / F.col("target"))
        .withColumn("owed", F.when(F.col("start") < end, F.greatest(F.col("finish") - end, F.lit(0.0)) * F.col("target")).otherwise(0.0))
        .withColumn("finish", F.when(F.col("start") < end, F.least("finish", end)).otherwise(F.col("finish")))
        .drop("piece")
    )
    ordered = pieces.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).withColumn("range", F.spark_partition_id())
    ordered = pinned(spark, ordered, "mix-order")
    total = times.agg(F.sum("size").alias("n")).first()["n"] or 0
    budget = F.lit(int(total * budget_share + 0.5)).cast("long")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ordered.groupBy("range").agg(F.sum("words").alias("n")).select(
        "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("range_start")
    )
    reached = F.broadcast(ranges.filter(F.col("range_start") < budget))  # one row per range of the sort
    in_range = Window.partitionBy("range").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ordered.join(reached, "range").withColumn("before", F.col("range_start") + F.sum("words").over(in_range) - F.col("words"))
    return placed.withColumn("taken", F.least("words", budget - F.col("before"))).filter("taken > 0")


def taken_by_source(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken."""
    times = pinned(spark, virtual_times(spark, docs), "mix-times")
    place = F.col("place").alias("queued")
    taken = mix_pieces(spark, times).groupBy("doc_id", "source", "size", place).agg(F.sum("taken").alias("taken"))
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"p.{c}")) for c in ("doc_id", "source", "size", "queued")]
    return (
        times.alias("t").join(taken.alias("p"), same[0] & same[1] & same[2] & same[3], "left")
        .select("t.doc_id", "t.source", "t.size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )


def taken_per_document(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken."""
    return taken_by_source(spark, docs).drop("source")


def mixed_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` as the mix reads them, all columns kept: one row per pass of which at least half is taken.

    Rows that repeat id, source and size all get the mean of their passes, rounded.
    """
    names = docs.columns
    taken = taken_by_source(spark, docs)
    keys = [F.col(c).alias(f"__{c}") for c in ("doc_id", "source", "size")]
    per_id = taken.groupBy(*keys).agg(F.floor(F.avg(F.col("taken") / F.greatest("size", F.lit(1))) + 0.5).cast("int").alias("__passes"))
    rows = docs.withColumn("__words", count_words(text_of()))
    same = rows["doc_id"].eqNullSafe(per_id["__doc_id"]) & rows["source"].eqNullSafe(per_id["__source"])
    joined = rows.join(per_id.filter("__passes > 0"), same & (rows["__words"] == per_id["__size"]))
    return (
        joined.withColumn("__pass", F.explode(F.sequence(F.lit(1), F.col("__passes"))))
        .select(*[rows[n] for n in names])
    )
