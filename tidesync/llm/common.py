"""Shared expressions and helpers of the corpus operators.

Conventions, unless an operator says otherwise:

* Operators read only the columns they name, so further columns do not clash; stages that return whole
  documents add columns that begin with two underscores, and documents must not have such names.
* A null text counts as empty. A null id is an id of its own that sorts after all others.
* An empty table gives an empty result with the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidesync.session import scratch_path

# White space and words of the contracts, as character classes.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def pinned(spark: SparkSession, df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(spark, f"llm-{purpose}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def count_words(text: Column) -> Column:
    """Number of words as a long, without building an array."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where ``body`` uses it in lambdas.

    A plain column reference may be inlined by the optimizer into a lambda and then computed for
    every element; a lambda variable cannot.
    """
    return F.transform(F.array(value), body)[0]


COPIES = 4096


def numbered_copies(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with a number from 0 for each of several equal rows, the same in each run.

    Equal rows meet as one row with their count (partial sums first), so no task gathers them; the count is
    dealt out again in blocks, row by row.
    """
    names = rows.columns
    counted = rows.groupBy(*names).agg(F.count("*").alias("__n"))
    last = F.col("__n") - 1
    blocks = counted.withColumn("__first", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(COPIES).cast("long"))))
    upto = F.least(last, F.col("__first") + (COPIES - 1))
    return blocks.withColumn(column, F.explode(F.sequence("__first", upto))).select(*names, column)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
