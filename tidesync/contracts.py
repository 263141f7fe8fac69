"""Table contracts: declared types, primary key, text length limits and defaults.

Spark enforces none of these on Parquet, so each contract is checked by the operators in
``tidesync.operators.checks`` and applied by ``tidesync.operators.load``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class TableContract:
    name: str
    schema: T.StructType
    key: tuple[str, ...]
    # column -> maximum character length (CHAR(n) / VARCHAR(n))
    lengths: dict[str, int] = field(default_factory=dict)
    # column -> SQL literal used as the insert default
    defaults: dict[str, str] = field(default_factory=dict)
    # columns whose empty string means "no value" (turned into NULL on load)
    empty_as_null: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.schema.fields]

    @property
    def value_columns(self) -> list[str]:
        return [c for c in self.columns if c not in self.key]

    def type_of(self, column: str) -> T.DataType:
        return self.schema[column].dataType

    def ddl(self) -> str:
        """Column list for ``CREATE TABLE`` with CHAR/VARCHAR kept from the contract."""
        parts = []
        for f in self.schema.fields:
            sql_type = f.dataType.simpleString()
            if f.name in self.lengths and isinstance(f.dataType, T.StringType):
                n = self.lengths[f.name]
                sql_type = f"char({n})" if n == 1 else f"varchar({n})"
            parts.append(f"{f.name} {sql_type}{'' if f.nullable else ' NOT NULL'}")
        return ", ".join(parts)

    def patch_schema(self) -> T.StructType:
        """Key plus every value column, all nullable: the shape of a partial update."""
        fields = [T.StructField(k, self.type_of(k), False) for k in self.key]
        fields += [T.StructField(c, self.type_of(c), True) for c in self.value_columns]
        return T.StructType(fields)


# The order entity as declared by the staging DDL and the merge schema.
ORDERS = TableContract(
    name="orders",
    schema=T.StructType([
        T.StructField("o_orderkey", T.LongType(), False),
        T.StructField("o_custkey", T.LongType(), True),
        T.StructField("o_orderstatus", T.StringType(), True),
        T.StructField("o_totalprice", T.DecimalType(15, 2), True),
        T.StructField("o_orderdate", T.DateType(), True),
        T.StructField("o_orderpriority", T.StringType(), True),
        T.StructField("o_clerk", T.StringType(), True),
        T.StructField("o_shippriority", T.IntegerType(), True),
        T.StructField("o_comment", T.StringType(), True),
    ]),
    key=("o_orderkey",),
    lengths={"o_orderstatus": 1, "o_orderpriority": 15, "o_clerk": 15, "o_comment": 79},
    # Defaults of a new order record.
    defaults={
        "o_orderstatus": "'O'",
        "o_orderpriority": "'3-MEDIUM'",
        "o_clerk": "'Clerk#000000001'",
        "o_shippriority": "0",
    },
    empty_as_null=("o_orderstatus",),
)

# A new-order record must carry every order field.
ORDER_CREATE_REQUIRED = tuple(ORDERS.columns)

# The staging copy carries a modification stamp set on insert and on every patch.
STAMP_COLUMN = "last_modified"
ORDERS_STAGING = TableContract(
    name="orders_staging",
    schema=T.StructType(list(ORDERS.schema.fields) + [T.StructField(STAMP_COLUMN, T.TimestampType(), True)]),
    key=ORDERS.key,
    lengths=ORDERS.lengths,
    defaults={**ORDERS.defaults, STAMP_COLUMN: "current_timestamp()"},
    empty_as_null=ORDERS.empty_as_null,
)

# The customer columns read from the synced copy.
CUSTOMER_VIEW_COLUMNS = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")

# Primary keys of the synced tables.
TPCH_KEYS: dict[str, tuple[str, ...]] = {
    "customer": ("c_custkey",),
    "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_linenumber"),
    "part": ("p_partkey",),
    "supplier": ("s_suppkey",),
    "nation": ("n_nationkey",),
    "region": ("r_regionkey",),
    "partsupp": ("ps_partkey", "ps_suppkey"),
}

# The table list of the bulk clone, in its order.
CLONE_TABLES = ("lineitem", "orders", "customer", "part", "supplier", "partsupp", "nation", "region")
