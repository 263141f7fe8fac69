"""Change batches derived from the lake tables by fixed key arithmetic.

The data set has no staging table, no patches and no JSON records, so they are derived from
``orders`` deterministically; ``tidesync.oracle`` derives the same inputs in SQL. The rules pick
which rows a batch touches; every operator still runs over the whole target table.

New keys are made by adding multiples of ``span = max(o_orderkey) + 1``, so they cannot collide
with existing keys at any scale. The span is one number, computed once by an aggregate over the
key column and used as a literal: as a scalar subquery it would be copied into every expression
that reads the shifted key.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidesync.contracts import ORDERS, STAMP_COLUMN
from tidesync.operators.sizing import measure

KEY = "o_orderkey"
# The as-of stamp and date used where the operators take "now" as an argument.
AS_OF_TIMESTAMP = "2024-06-30 12:00:00"
AS_OF_DATE = "2024-06-30"
#: Estimated in-memory bytes of a change file, at most.
CHANGE_FILE_BYTES = 512 * 1024 * 1024


def _k() -> Column:
    return F.col(KEY)


def key_span(lake: DataFrame) -> int:
    """``max(o_orderkey) + 1`` of the lake orders (one aggregate over the key column)."""
    value = lake.agg((F.max(KEY) + 1).alias("span")).first()["span"]
    return int(value) if value is not None else 1


def _span(lake: DataFrame, span: int | None) -> Column:
    return F.lit(span if span is not None else key_span(lake)).cast("long")


def staging(lake: DataFrame, span: int | None = None) -> DataFrame:
    """Staged orders: updates of every 10th key (price + 1.00; every 100th key has a NULL clerk)
    and inserts copied from every 50th key, shifted to new keys."""
    span = _span(lake, span)
    updates = lake.where(_k() % 10 == 0).select(*[
        (F.col(c) + F.lit(1).cast("decimal(15,2)")).cast("decimal(15,2)").alias(c) if c == "o_totalprice"
        else F.when(_k() % 100 == 0, F.lit(None).cast("string")).otherwise(F.col(c)).alias(c) if c == "o_clerk"
        else F.col(c)
        for c in ORDERS.columns])
    inserts = lake.where(_k() % 50 == 0).select(*[(_k() + span).alias(c) if c == KEY else F.col(c)
                                                   for c in ORDERS.columns])
    return updates.unionByName(inserts)


def staging_dup(staged: DataFrame) -> DataFrame:
    """Staging plus its rows of every 500th key a second time with price + 5.00 (repeated keys;
    the later copy has the higher price)."""
    again = staged.where(_k() % 500 == 0).select(*[
        (F.col(c) + F.lit(5).cast("decimal(15,2)")).cast("decimal(15,2)").alias(c) if c == "o_totalprice"
        else F.col(c) for c in ORDERS.columns])
    return staged.unionByName(again)


def patches(staged: DataFrame, lake: DataFrame, span: int | None = None) -> DataFrame:
    """Partial updates of the staging table.

    * every 20th staged key: status 'P', price 0.00 for every 40th, other fields NULL;
    * staged keys = 35 mod 70: no field at all (rejected as ``no_fields``);
    * every 45th staged key shifted by 2 * span: unknown key (``not_found``).
    """
    span = _span(lake, span)
    schema = ORDERS.patch_schema()

    def shaped(df: DataFrame, given: dict[str, Column]) -> DataFrame:
        return df.select(*[
            (given[f.name] if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name)
            if f.name != KEY else F.col(KEY) for f in schema.fields])

    ok = shaped(staged.where(_k() % 20 == 0), {
        "o_orderstatus": F.lit("P"),
        "o_totalprice": F.when(_k() % 40 == 0, F.lit(0)),
    })
    empty = shaped(staged.where(_k() % 70 == 35), {})
    unknown = shaped(staged.where(_k() % 45 == 0).select((_k() + 2 * span).alias(KEY)),
                     {"o_orderstatus": F.lit("F")})
    return ok.unionByName(empty).unionByName(unknown)


def delete_keys(staged: DataFrame, lake: DataFrame, span: int | None = None) -> DataFrame:
    """Every 30th staged key, plus every 45th shifted to an unknown key."""
    span = _span(lake, span)
    return (staged.where(_k() % 30 == 0).select(KEY)
            .unionByName(staged.where(_k() % 45 == 0).select((_k() + 2 * span).alias(KEY))))


def insert_batch(lake: DataFrame, span: int | None = None) -> DataFrame:
    """Every 25th lake order: keys = 0 mod 50 keep their key (already staged), keys = 25 mod 50
    move to new keys (3 * span); those = 25 mod 1000 come twice (second copy re-commented)."""
    span = _span(lake, span)
    base = lake.where(_k() % 25 == 0).select(*[
        F.when(_k() % 50 == 25, _k() + 3 * span).otherwise(_k()).alias(c) if c == KEY else F.col(c)
        for c in ORDERS.columns])
    again = lake.where(_k() % 1000 == 25).select(*[
        (_k() + 3 * span).alias(c) if c == KEY
        else F.concat(F.lit("again "), F.col(c)).alias(c) if c == "o_comment"
        else F.col(c) for c in ORDERS.columns])
    return base.unionByName(again)


def skewed_orders(lake: DataFrame) -> DataFrame:
    """The lake orders with every third order given to customer 1."""
    return lake.withColumn("o_custkey", F.when(_k() % 3 == 0, F.lit(1).cast("long")).otherwise(F.col("o_custkey")).cast("long"))


def customer_clerks(customer: DataFrame) -> DataFrame:
    """A clerk for each customer, by key arithmetic; customers = 0 mod 7 have none."""
    clerk = F.concat(F.lit("Clerk#"), F.lpad((F.col("c_custkey") % 50).cast("string"), 9, "0"))
    return customer.select(F.col("c_custkey").cast("long").alias("o_custkey"),
                           F.when(F.col("c_custkey") % 7 != 0, clerk).alias("o_clerk"))


def json_records(staged: DataFrame) -> DataFrame:
    """Staged orders as JSON text, spoiled by key: non-numeric price (key = 0 mod 70), missing key
    (0 mod 110), two-letter status (0 mod 130), empty status (0 mod 170; accepted as it is)."""
    cols = []
    for c in ORDERS.columns:
        if c == KEY:
            cols.append(F.when(_k() % 110 == 0, F.lit(None).cast("long")).otherwise(_k()).alias(c))
        elif c == "o_totalprice":
            cols.append(F.when(_k() % 70 == 0, F.lit("n/a")).otherwise(F.col(c).cast("string")).alias(c))
        elif c == "o_orderstatus":
            cols.append(F.when(_k() % 130 == 0, F.lit("XX")).when(_k() % 170 == 0, F.lit("")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return staged.select(F.to_json(F.struct(*cols)).alias("value"))


def sparse_new_orders(staged: DataFrame) -> DataFrame:
    """New-order records with fields left empty by the form: every 3rd key lacks status,
    priority, clerk, ship priority and date."""
    blank = ["o_orderstatus", "o_orderpriority", "o_clerk", "o_shippriority", "o_orderdate"]
    return staged.select(*[
        F.when(_k() % 3 == 0, F.lit(None).cast(ORDERS.type_of(c))).otherwise(F.col(c)).alias(c) if c in blank
        else F.col(c) for c in ORDERS.columns])


def staging_with_bad_rows(staged: DataFrame) -> DataFrame:
    """The staging plus rows that break the contract: every 20th key again without its key, every
    30th again with a comment that is too long."""
    no_key = staged.where(_k() % 20 == 0).withColumn("o_orderkey", F.lit(None).cast("long"))
    long_text = staged.where(_k() % 30 == 0).withColumn("o_comment", F.repeat(F.lit("x"), F.lit(80)))
    return staged.unionByName(no_key).unionByName(long_text)


def stamped_staging(staged: DataFrame, later: bool) -> DataFrame:
    """The staging with modification stamps, as two runs find it. Earlier: rows with key != 0 mod 3, in the
    first hour of the as-of date; those = 0 mod 20 still have price 0. Later: all rows; the patched ones and those
    with key = 0 mod 3 are stamped in the second hour, but for key = 0 mod 12: their transactions began in the last
    ten minutes of the first hour and were not seen then."""
    start = int(dt.datetime.fromisoformat(AS_OF_DATE).replace(tzinfo=dt.timezone.utc).timestamp())
    patched = (_k() % 20 == 0) & (_k() % 3 != 0)
    first_hour = F.lit(start) + _k() % 3600
    price = F.col("o_totalprice")
    if not later:
        rows = staged.where(_k() % 3 != 0)
        price, second = F.when(patched, F.lit(0)).otherwise(price), first_hour
    else:
        rows = staged
        second = F.when(_k() % 12 == 0, F.lit(start + 3599) - _k() % 600).when(
            patched | (_k() % 3 == 0), first_hour + 3600).otherwise(first_hour)
    return rows.withColumn("o_totalprice", price.cast("decimal(15,2)")).withColumn(STAMP_COLUMN, F.timestamp_seconds(second))


def key_changes(df: DataFrame, key) -> DataFrame:
    """Changes of any table by its first key column: rows with key = 3 mod 10 are deleted, rows with key = 0
    mod 10 are copied to new keys (shifted by the largest key + 1); seq 1."""
    k = F.col(key[0])
    span = df.agg((F.max(key[0]) + 1).alias("span")).first()["span"] or 1
    deleted = df.where(k % 10 == 3).withColumn("op", F.lit("D"))
    shifted = (k + F.lit(span)).cast(df.schema[key[0]].dataType)
    added = df.where(k % 10 == 0).withColumn(key[0], shifted).withColumn("op", F.lit(None).cast("string"))
    return deleted.unionByName(added).withColumn("seq", F.lit(1).cast("long"))


def change_feed_parts(staged: DataFrame, n_parts: int = 4) -> list[DataFrame]:
    """The staging split into ``n_parts`` change files by key; part i carries ``seq = i + 1``.
    Part 0 additionally re-sends every 7th key of the later parts with a stale price, which the
    later parts must win over (they have a higher seq)."""
    parts = []
    for i in range(n_parts):
        part = staged.where(F.pmod(F.xxhash64(_k()), F.lit(n_parts)) == i)
        if i == 0:
            stale = staged.where((F.pmod(F.xxhash64(_k()), F.lit(n_parts)) != 0) & (_k() % 7 == 0)).select(*[
                F.lit(0).cast("decimal(15,2)").alias(c) if c == "o_totalprice" else F.col(c)
                for c in ORDERS.columns])
            part = part.unionByName(stale)
        parts.append(part.withColumn("seq", F.lit(i + 1).cast("long")))
    return parts


def change_files(part: DataFrame, key, most_bytes: int = CHANGE_FILE_BYTES) -> DataFrame:
    """A change part dealt out to its files: one, or as many as its bytes ask for. The part is computed by as many
    tasks as its sources have and then shuffled, so a file's task reads that file's rows and never the lake."""
    files = max(1, -(-measure(part).bytes // most_bytes))
    return part.repartition(files, *key)
