"""Record ingest with type checking: JSON order records → typed accepted rows + rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidesync.contracts import TableContract
from tidesync.operators.load import Split, validate


def text_schema(contract: TableContract) -> T.StructType:
    """Every contract field as text, so a malformed value survives parsing and can be reported."""
    return T.StructType([T.StructField(c, T.StringType(), True) for c in contract.columns])


def parse_records(records: DataFrame, contract: TableContract, value_col: str = "value",
                  required: tuple[str, ...] = ()) -> Split:
    """Parse one JSON object per row and split into accepted / rejected under ``contract``.

    Numbers and strings both arrive as text; the contract's casts decide. An empty text stays empty (only
    the load of the staging into the lake makes it NULL). The raw record is kept
    on rejected rows for inspection.
    """
    return validate(flatten_records(records, contract, value_col), contract, required, keep_empty=True)


def flatten_records(records: DataFrame, contract: TableContract, value_col: str = "value") -> DataFrame:
    """JSON text → one text column per contract field plus the raw ``record``.

    One parse per record: ``inline`` over a one-element array is a Generate node, which stops
    Catalyst from substituting ``from_json`` into every later field access and filter (it would
    otherwise parse the text again for each referenced field).
    """
    parsed = F.struct(*[F.col(f"__r.{c}").alias(c) for c in contract.columns],
                      F.col(value_col).alias("record"))
    return (records.select(F.from_json(F.col(value_col), text_schema(contract)).alias("__r"), F.col(value_col))
            .select(F.inline(F.array(parsed))))


def read_json_records(spark, path: str, contract: TableContract) -> Split:
    """JSON-lines files (one order per line) with every field read as text."""
    return parse_records(spark.read.text(path), contract)


def to_json_records(df: DataFrame, value_col: str = "value") -> DataFrame:
    """Rows out as JSON records."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias(value_col))
