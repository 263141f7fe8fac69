"""Exact deduplication by content sort (native DataFrame operators only).

Method: sampled splitters range-partition the rows on their normalised text, an external sort
places equal texts next to each other, and the run of equal neighbours (full comparison) is
numbered, best row first; its first row also carries the number of its rows. A text that many rows share would
fill one range, so the range key carries a slice of the row's id: the sampled splitters cut a hot text into up
to ``slices`` runs, whose number follows the number of rows (``RUN_ROWS``). The first rows of the runs, and only these,
meet by the SHA-256 of their normalised text: the best of them stays and the run lengths add up.

Only the first 64 characters serve as splitter key, so the sample on the driver stays small
whatever the text lengths; the sort and the runs compare whole texts.

Cases: a null text is empty, and all empty texts are equal. Among equal texts the row with the most
code points stays, then the smallest id, a null id last. Rows that repeat both id and text form one
group like any other; the first of them in the sorted run has ``kept``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidesync.llm.common import SPACE, pinned, text_of


def normalised(text: Column) -> Column:
    """The text without any white-space character."""
    return F.regexp_replace(text, SPACE + "+", "")


#: Slices of a text that all rows share: at least LEAST_SLICES, beyond that one per RUN_ROWS rows of the table.
LEAST_SLICES, RUN_ROWS = 64, 100_000


def exact_groups(spark: SparkSession, docs: DataFrame, slices: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    text = text_of()
    slices = slices or max(LEAST_SLICES, docs.count() // RUN_ROWS)
    rows = (
        docs.select("doc_id", F.length(text).alias("n_code_points"), normalised(text).alias("norm"))
        .withColumn("head", F.substring("norm", 1, 64))
        .withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(slices)))
    )
    run = Window.partitionBy("head", "norm", "slice").orderBy(
        F.desc("n_code_points"), F.asc_nulls_last("doc_id")
    )
    sorted_rows = rows.repartitionByRange("head", "slice").select(
        "*", F.row_number().over(run).alias("rank"), F.count("*").over(run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("run_size")
    )
    first = F.col("rank") == 1
    rows = pinned(
        spark,
        sorted_rows.select(
            "doc_id", "n_code_points", "slice", first.alias("first"), F.when(first, F.col("run_size")).alias("run_size"),
            F.sha2("norm", 256).alias("text_sha256"),
        ),
        "exact-rows",
    )
    best = F.struct((-F.col("n_code_points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "slice")
    groups = pinned(
        spark,
        rows.filter("first").groupBy("text_sha256")
        .agg(F.sum("run_size").alias("group_size"), F.min(best).alias("best"))
        .filter("group_size > 1")
        .select("text_sha256", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.slice").alias("best_slice")),
        "exact-groups",
    )
    alone = F.col("group_size").isNull()
    keep_id = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.join(groups, "text_sha256", "left").select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("first") & (F.col("slice") == F.col("best_slice")))).alias("kept"),
        "text_sha256",
    )


def drop_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept."""
    names = docs.columns
    kept = exact_groups(spark, docs).filter("kept").select(
        F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), F.lit(True).alias("__kept")
    )
    rows = docs.withColumn("__sha", F.sha2(normalised(text_of()), 256))
    joined = rows.join(kept, (rows["doc_id"].eqNullSafe(kept["__id"])) & (rows["__sha"] == kept["__sha"]))
    first = Window.partitionBy(rows["doc_id"], rows["__sha"]).orderBy(F.desc(F.length(text_of())))
    return joined.withColumn("__n", F.row_number().over(first)).filter("__n = 1").select(
        *[rows[n] for n in names]
    )


ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS s
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY s ORDER BY length(t) DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY s) AS group_size,
       row_number() OVER (PARTITION BY s ORDER BY length(t) DESC, doc_id) = 1 AS kept,
       sha256(s) AS text_sha256
FROM n
"""
