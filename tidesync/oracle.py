"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each statement runs on the raw tables (views ``orders``, ``customer``, ``lineitem``, ...),
derives the same inputs as ``tidesync.sources.fixtures`` in plain SQL and computes the expected
result without any of the library's code. Column names and types match the Spark results.
"""

from __future__ import annotations

from tidesync.contracts import CLONE_TABLES, ORDERS, TPCH_KEYS
from tidesync.plans import queries as Q

COLS = ORDERS.columns
VALUE_COLS = [c for c in COLS if c != "o_orderkey"]
SQL_TYPES = {
    "o_orderkey": "BIGINT", "o_custkey": "BIGINT", "o_orderstatus": "VARCHAR",
    "o_totalprice": "DECIMAL(15,2)", "o_orderdate": "DATE", "o_orderpriority": "VARCHAR",
    "o_clerk": "VARCHAR", "o_shippriority": "INTEGER", "o_comment": "VARCHAR",
}


def _cols(prefix: str = "") -> str:
    return ", ".join(f"{prefix}{c}" for c in COLS)


def _esc(s: str) -> str:
    return s.replace("'", "''")


LAKE = """
lake AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
         CAST(o_totalprice AS DECIMAL(15,2)) AS o_totalprice,
         CAST(o_orderdate AS DATE) AS o_orderdate,
         o_orderpriority,
         'Clerk#' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 9, '0') AS o_clerk,
         CAST(0 AS INTEGER) AS o_shippriority,
         o_orderpriority || ' order for customer ' || CAST(o_custkey AS VARCHAR) AS o_comment
  FROM orders
),
span AS (SELECT max(o_orderkey) + 1 AS s FROM orders)"""

STAGING = LAKE + """,
staging AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
         CAST(o_totalprice + 1 AS DECIMAL(15,2)) AS o_totalprice, o_orderdate, o_orderpriority,
         CASE WHEN o_orderkey % 100 = 0 THEN NULL ELSE o_clerk END AS o_clerk,
         o_shippriority, o_comment
  FROM lake WHERE o_orderkey % 10 = 0
  UNION ALL
  SELECT o_orderkey + (SELECT s FROM span), o_custkey, o_orderstatus, o_totalprice, o_orderdate,
         o_orderpriority, o_clerk, o_shippriority, o_comment
  FROM lake WHERE o_orderkey % 50 = 0
)"""

MERGED = STAGING + f""",
merged AS (
  SELECT t.o_orderkey,
         {", ".join(f"CASE WHEN s.o_orderkey IS NOT NULL THEN s.{c} ELSE t.{c} END AS {c}" for c in VALUE_COLS)}
  FROM lake t LEFT JOIN staging s ON t.o_orderkey = s.o_orderkey
  UNION ALL
  SELECT {_cols("s.")} FROM staging s
  WHERE NOT EXISTS (SELECT 1 FROM lake t WHERE t.o_orderkey = s.o_orderkey)
),
classes AS (
  SELECT s.o_orderkey,
         CASE WHEN EXISTS (SELECT 1 FROM lake t WHERE t.o_orderkey = s.o_orderkey)
              THEN 'update' ELSE 'insert' END AS match_class
  FROM staging s
)"""

MERGED_LATEST = STAGING + f""",
dedup AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
         CASE WHEN o_orderkey % 500 = 0 THEN CAST(o_totalprice + 5 AS DECIMAL(15,2)) ELSE o_totalprice END AS o_totalprice,
         o_orderdate, o_orderpriority, o_clerk, o_shippriority, o_comment
  FROM staging
),
merged AS (
  SELECT t.o_orderkey,
         {", ".join(f"CASE WHEN s.o_orderkey IS NOT NULL THEN s.{c} ELSE t.{c} END AS {c}" for c in VALUE_COLS)}
  FROM lake t LEFT JOIN dedup s ON t.o_orderkey = s.o_orderkey
  UNION ALL
  SELECT {_cols("s.")} FROM dedup s
  WHERE NOT EXISTS (SELECT 1 FROM lake t WHERE t.o_orderkey = s.o_orderkey)
)"""

DELETE_KEYS = STAGING + """,
delete_keys AS (
  SELECT o_orderkey FROM staging WHERE o_orderkey % 30 = 0
  UNION ALL
  SELECT o_orderkey + 2 * (SELECT s FROM span) FROM staging WHERE o_orderkey % 45 = 0
)"""


def _null(c: str) -> str:
    return f"CAST(NULL AS {SQL_TYPES[c]}) AS {c}"


PATCHES = STAGING + f""",
patches AS (
  SELECT o_orderkey, {", ".join(
      "CAST('P' AS VARCHAR) AS o_orderstatus" if c == "o_orderstatus"
      else "CAST(CASE WHEN o_orderkey % 40 = 0 THEN 0 END AS DECIMAL(15,2)) AS o_totalprice" if c == "o_totalprice"
      else _null(c) for c in VALUE_COLS)}
  FROM staging WHERE o_orderkey % 20 = 0
  UNION ALL
  SELECT o_orderkey, {", ".join(_null(c) for c in VALUE_COLS)}
  FROM staging WHERE o_orderkey % 70 = 35
  UNION ALL
  SELECT o_orderkey + 2 * (SELECT s FROM span), {", ".join(
      "CAST('F' AS VARCHAR) AS o_orderstatus" if c == "o_orderstatus" else _null(c) for c in VALUE_COLS)}
  FROM staging WHERE o_orderkey % 45 = 0
),
given AS (
  SELECT * FROM patches WHERE {" OR ".join(f"{c} IS NOT NULL" for c in VALUE_COLS)}
),
no_fields AS (
  SELECT DISTINCT o_orderkey FROM patches WHERE {" AND ".join(f"{c} IS NULL" for c in VALUE_COLS)}
)"""

INSERT_BATCH = STAGING + f""",
batch AS (
  SELECT CASE WHEN o_orderkey % 50 = 25 THEN o_orderkey + 3 * (SELECT s FROM span) ELSE o_orderkey END AS o_orderkey,
         {", ".join(VALUE_COLS)}
  FROM lake WHERE o_orderkey % 25 = 0
  UNION ALL
  SELECT o_orderkey + 3 * (SELECT s FROM span), {", ".join(
      "'again ' || o_comment AS o_comment" if c == "o_comment" else c for c in VALUE_COLS)}
  FROM lake WHERE o_orderkey % 1000 = 25
),
dups AS (SELECT o_orderkey FROM batch GROUP BY o_orderkey HAVING count(*) > 1),
uniq AS (SELECT * FROM batch WHERE o_orderkey NOT IN (SELECT o_orderkey FROM dups)),
present AS (SELECT o_orderkey FROM uniq WHERE o_orderkey IN (SELECT o_orderkey FROM staging)),
inserted AS (SELECT * FROM uniq WHERE o_orderkey NOT IN (SELECT o_orderkey FROM present))"""

SEED = STAGING + f""",
candidates AS (SELECT {_cols()} FROM lake ORDER BY o_orderkey LIMIT {Q.SEED_SIZE}),
new_rows AS (
  SELECT * FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM staging s WHERE s.o_orderkey = c.o_orderkey)
)"""

# The JSON records as parsed text fields (every field as text, NULL when absent).
RECORDS = STAGING + f""",
records AS (
  SELECT CASE WHEN o_orderkey % 110 = 0 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) END AS o_orderkey,
         CAST(o_custkey AS VARCHAR) AS o_custkey,
         CASE WHEN o_orderkey % 130 = 0 THEN 'XX' WHEN o_orderkey % 170 = 0 THEN '' ELSE o_orderstatus END AS o_orderstatus,
         CASE WHEN o_orderkey % 70 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR) END AS o_totalprice,
         CAST(o_orderdate AS VARCHAR) AS o_orderdate,
         o_orderpriority, o_clerk,
         CAST(o_shippriority AS VARCHAR) AS o_shippriority,
         o_comment
  FROM staging
),
checked AS (
  SELECT *, CASE
    WHEN o_orderkey IS NULL OR o_orderkey = '' THEN 'missing_key:o_orderkey'
    {" ".join(f"WHEN {c} IS NOT NULL AND TRY_CAST({c} AS {SQL_TYPES[c]}) IS NULL THEN 'bad_type:{c}'"
              for c in COLS if SQL_TYPES[c] != "VARCHAR")}
    {" ".join(f"WHEN length({c}) > {n} THEN 'too_long:{c}'" for c, n in ORDERS.lengths.items())}
  END AS reason,
  CASE
    WHEN o_orderkey IS NULL OR o_orderkey = '' THEN 'missing_key:o_orderkey'
    {" ".join(f"WHEN {c} IS NULL THEN 'missing_field:{c}'" for c in COLS if c != "o_orderkey")}
    {" ".join(f"WHEN {c} IS NOT NULL AND TRY_CAST({c} AS {SQL_TYPES[c]}) IS NULL THEN 'bad_type:{c}'"
              for c in COLS if SQL_TYPES[c] != "VARCHAR")}
    {" ".join(f"WHEN length({c}) > {n} THEN 'too_long:{c}'" for c, n in ORDERS.lengths.items())}
  END AS strict_reason
  FROM records
)"""


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body}"


def _ilike(col: str, term: str) -> str:
    return f"{col} ILIKE '%{_esc(term)}%' ESCAPE '\\'"


def _count_sql(table: str, key: tuple[str, ...], name: str) -> str:
    src = ("(SELECT DISTINCT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey FROM lineitem)"
           if table == "partsupp" else table)
    k = ", ".join(key)
    null_key = " OR ".join(f"{c} IS NULL" for c in key)
    return (f"SELECT '{name}' AS table_name, CAST(COALESCE(sum(n), 0) AS BIGINT) AS n_rows, count(*) AS n_keys, "
            f"count(*) FILTER (WHERE n > 1) AS n_repeated_keys, "
            f"CAST(COALESCE(sum(CASE WHEN nk THEN n END), 0) AS BIGINT) AS n_null_key_rows "
            f"FROM (SELECT {k}, count(*) AS n, bool_or({null_key}) AS nk FROM {src} GROUP BY {k}) g")


def _synced_count(table: str) -> str:
    """Rows and key sum of a table after the deletes and inserts of ``fixtures.key_changes``."""
    k = TPCH_KEYS[table][0]
    src = ("(SELECT DISTINCT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey FROM lineitem)" if table == "partsupp"
           else f"(SELECT DISTINCT {', '.join(TPCH_KEYS[table])} FROM {table})")
    return (f"SELECT '{table}' AS table_name, count(*) AS n_rows, CAST(COALESCE(sum(k), 0) AS BIGINT) AS key_sum FROM ("
            f"SELECT {k} AS k FROM {src} s WHERE {k} % 10 != 3 UNION ALL "
            f"SELECT {k} + (SELECT max({k}) + 1 FROM {src} m) AS k FROM {src} s WHERE {k} % 10 = 0) x")


def _patched_state() -> str:
    return _with(PATCHES, f"""
SELECT t.o_orderkey, {", ".join(f"COALESCE(p.{c}, t.{c}) AS {c}" for c in VALUE_COLS)}
FROM staging t LEFT JOIN (
  SELECT * FROM given WHERE o_orderkey IN (SELECT o_orderkey FROM given GROUP BY 1 HAVING count(*) = 1)
) p ON t.o_orderkey = p.o_orderkey""")


def oracle_sql() -> dict[str, str]:
    lit_date = Q.fixtures.AS_OF_DATE
    defaults = {"o_orderstatus": "'O'", "o_orderpriority": "'3-MEDIUM'", "o_clerk": "'Clerk#000000001'",
                "o_shippriority": "CAST(0 AS INTEGER)", "o_orderdate": f"DATE '{lit_date}'"}
    blank = ["o_orderstatus", "o_orderpriority", "o_clerk", "o_shippriority", "o_orderdate"]
    return {
        "snapshot_clone": _with(LAKE, "SELECT * FROM lake"),
        "clone_row_counts": "\nUNION ALL\n".join(
            f"SELECT '{t}' AS table_name, count(*) AS row_count FROM "
            + ("(SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) p" if t == "partsupp" else t)
            for t in CLONE_TABLES),
        "staging_scan": _with(STAGING, "SELECT * FROM staging"),
        "typed_staging": _with(STAGING, f"""
SELECT {", ".join("CASE WHEN o_orderkey % 90 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus"
                  if c == "o_orderstatus" else c for c in COLS)} FROM staging"""),
        "seed_candidates": _with(LAKE, f"SELECT * FROM lake ORDER BY o_orderkey LIMIT {Q.SEED_SIZE}"),
        "ingest_accept": _with(RECORDS, f"""
SELECT {", ".join(f"CAST({c} AS {SQL_TYPES[c]}) AS {c}" for c in COLS)} FROM checked WHERE reason IS NULL"""),
        "ingest_reject_counts": _with(RECORDS, "SELECT reason, count(*) AS n_rows FROM checked WHERE reason IS NOT NULL GROUP BY reason"),
        "ingest_new_order_reject_counts": _with(RECORDS, """
SELECT strict_reason AS reason, count(*) AS n_rows FROM checked WHERE strict_reason IS NOT NULL GROUP BY strict_reason"""),
        "search_text_indexed": _with(LAKE, f"SELECT * FROM lake WHERE {_ilike('o_comment', Q.SEARCH_TERM)}"),
        "count_search_indexed": _with(LAKE, " UNION ALL ".join(
            f"SELECT '{_esc(t)}' AS term, count(*) AS n_rows FROM lake WHERE {_ilike('o_comment', t)}"
            for t in (Q.SEARCH_TERM, Q.WILDCARD_TERM))),
        "search_text": _with(LAKE, f"SELECT * FROM lake WHERE {_ilike('o_comment', Q.SEARCH_TERM)}"),
        "search_empty_term": _with(LAKE, "SELECT * FROM lake"),
        "get_by_key": _with(LAKE, f"SELECT * FROM lake WHERE o_orderkey = {Q.LOOKUP_KEY}"),
        "get_by_keys": _with(DELETE_KEYS, "SELECT * FROM staging WHERE o_orderkey IN (SELECT o_orderkey FROM delete_keys)"),
        "missing_keys": _with(DELETE_KEYS, "SELECT o_orderkey FROM delete_keys WHERE o_orderkey NOT IN (SELECT o_orderkey FROM staging)"),
        "count_all": _with(LAKE, "SELECT count(*) AS count FROM lake"),
        "count_search": _with(LAKE, f"SELECT count(*) AS count FROM lake WHERE {_ilike('o_comment', Q.STATS_TERM)}"),
        "page_stats": _with(LAKE, f"""
SELECT total_rows,
       CAST({Q.PAGE_OFFSET // Q.PAGE_LIMIT + 1} AS BIGINT) AS page_number,
       greatest(CAST(ceil(total_rows / {Q.PAGE_LIMIT}) AS BIGINT), CAST(1 AS BIGINT)) AS page_count,
       CAST({Q.PAGE_OFFSET + 1} AS BIGINT) AS first_shown,
       least(CAST({Q.PAGE_OFFSET + Q.PAGE_LIMIT} AS BIGINT), total_rows) AS last_shown,
       {"true" if Q.PAGE_OFFSET != 0 else "false"} AS has_previous,
       {Q.PAGE_OFFSET + Q.PAGE_LIMIT} < total_rows AS has_next
FROM (SELECT count(*) AS total_rows FROM lake WHERE {_ilike('o_comment', Q.STATS_TERM)}) c"""),
        "page_orders": _with(LAKE, f"SELECT * FROM lake ORDER BY o_orderkey LIMIT {Q.PAGE_LIMIT} OFFSET {Q.PAGE_OFFSET}"),
        "page_search": _with(LAKE, f"""
SELECT * FROM lake WHERE {_ilike('o_comment', Q.WILDCARD_TERM)}
ORDER BY o_orderkey LIMIT {Q.PAGE_LIMIT} OFFSET {Q.SEARCH_PAGE_OFFSET}"""),
        "page_deep": _with(LAKE, f"SELECT * FROM lake ORDER BY o_orderkey LIMIT {Q.PAGE_LIMIT} OFFSET {Q.DEEP_OFFSET}"),
        "page_customers": f"""
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
ORDER BY c_custkey LIMIT {Q.CUSTOMER_LIMIT} OFFSET {Q.CUSTOMER_OFFSET}""",
        "page_keyset": _with(LAKE, f"SELECT * FROM lake WHERE o_orderkey > {Q.KEYSET_AFTER} ORDER BY o_orderkey LIMIT {Q.PAGE_LIMIT}"),
        "merge_orders": _with(MERGED, "SELECT * FROM merged"),
        "merge_match_classes": _with(MERGED, "SELECT * FROM classes"),
        "merge_metrics": _with(MERGED, """
SELECT count(*) AS num_affected_rows,
       count(*) FILTER (WHERE match_class = 'update') AS num_updated_rows,
       CAST(0 AS BIGINT) AS num_deleted_rows,
       count(*) FILTER (WHERE match_class = 'insert') AS num_inserted_rows
FROM classes"""),
        "merge_split": _with(LAKE, """,
skewed AS (SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_custkey END AS o_custkey) FROM lake),
clerks AS (
  SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN 'Clerk#' || lpad(CAST(c_custkey % 50 AS VARCHAR), 9, '0') END AS clerk
  FROM customer
)
""" + f"""SELECT {", ".join({"o_custkey": "CAST(COALESCE(t.o_custkey, s.c_custkey) AS BIGINT) AS o_custkey",
                   "o_clerk": "CASE WHEN s.c_custkey IS NOT NULL THEN s.clerk ELSE t.o_clerk END AS o_clerk"}.get(c, f"t.{c}") for c in COLS)}
FROM skewed t FULL JOIN clerks s ON t.o_custkey = s.c_custkey"""),
        "page_ranked": _with(MERGED, f"SELECT * FROM merged ORDER BY o_orderkey LIMIT {Q.PAGE_LIMIT} OFFSET {Q.RANKED_OFFSET}"),
        "insert_sketched": _with(INSERT_BATCH, """
SELECT * FROM lake UNION ALL SELECT * FROM uniq WHERE o_orderkey NOT IN (SELECT o_orderkey FROM lake)"""),
        "insert_sketched_conflicts": _with(INSERT_BATCH, """
SELECT o_orderkey, 'duplicate_in_batch' AS reason FROM dups
UNION ALL SELECT o_orderkey, 'exists' AS reason FROM uniq WHERE o_orderkey IN (SELECT o_orderkey FROM lake)"""),
        "merge_twice": _with(MERGED, "SELECT * FROM merged"),
        "merge_shuffle": _with(MERGED, "SELECT * FROM merged"),
        "merge_latest": _with(MERGED_LATEST, "SELECT * FROM merged"),
        "staging_key_violations": _with(STAGING, """
SELECT o_orderkey, CAST(2 AS BIGINT) AS n_rows FROM staging WHERE o_orderkey % 500 = 0"""),
        "forward_merge": _with(MERGED, "SELECT * FROM merged"),
        "forward_merge_buckets": _with(MERGED, "SELECT * FROM merged"),
        "forward_with_bad_rows": _with(MERGED, "SELECT * FROM merged"),
        "forward_rejects": _with(STAGING, """
SELECT 'missing_key:o_orderkey' AS reason, count(*) AS n_rows FROM staging WHERE o_orderkey % 20 = 0 HAVING count(*) > 0
UNION ALL
SELECT 'too_long:o_comment' AS reason, count(*) AS n_rows FROM staging WHERE o_orderkey % 30 = 0 HAVING count(*) > 0"""),
        "forward_metrics": _with(MERGED, """
SELECT count(*) AS num_affected_rows,
       count(*) FILTER (WHERE match_class = 'update') AS num_updated_rows,
       CAST(0 AS BIGINT) AS num_deleted_rows,
       count(*) FILTER (WHERE match_class = 'insert') AS num_inserted_rows,
       (SELECT count(*) FROM staging) + (SELECT count(*) FROM staging WHERE o_orderkey % 20 = 0)
         + (SELECT count(*) FROM staging WHERE o_orderkey % 30 = 0) AS fetched_rows,
       (SELECT count(*) FROM staging WHERE o_orderkey % 20 = 0)
         + (SELECT count(*) FROM staging WHERE o_orderkey % 30 = 0) AS rejected_rows
FROM classes"""),
        "forward_incremental": _with(MERGED, "SELECT * FROM merged"),
        "forward_incremental_buckets": _with(MERGED, "SELECT * FROM merged"),
        "forward_incremental_metrics": _with(MERGED, """,
changed AS (
  SELECT s.o_orderkey, s.o_orderkey % 3 <> 0 OR EXISTS (SELECT 1 FROM lake t WHERE t.o_orderkey = s.o_orderkey) AS present
  FROM staging s WHERE s.o_orderkey % 3 = 0 OR s.o_orderkey % 20 = 0
)
SELECT count(*) AS num_affected_rows,
       count(*) FILTER (WHERE present) AS num_updated_rows,
       CAST(0 AS BIGINT) AS num_deleted_rows,
       count(*) FILTER (WHERE NOT present) AS num_inserted_rows,
       count(*) AS fetched_rows, CAST(0 AS BIGINT) AS rejected_rows,
       count(*) FILTER (WHERE o_orderkey % 12 = 0 AND 3599 - o_orderkey % 600
         < (SELECT max(o_orderkey % 3600) FROM staging WHERE o_orderkey % 3 <> 0)) AS late_rows
FROM changed"""),
        "insert_strict": _with(INSERT_BATCH, "SELECT * FROM staging UNION ALL SELECT * FROM inserted"),
        "insert_conflicts": _with(INSERT_BATCH, """
SELECT o_orderkey, 'exists' AS reason FROM present
UNION ALL SELECT o_orderkey, 'duplicate_in_batch' AS reason FROM dups"""),
        "insert_returning": _with(INSERT_BATCH, f"SELECT *, CAST(epoch(TIMESTAMP '{Q.fixtures.AS_OF_TIMESTAMP}') AS BIGINT) AS last_modified_s FROM inserted"),
        "patch_returning": _with(PATCHES, f"""
SELECT t.o_orderkey, {", ".join(f"COALESCE(p.{c}, t.{c}) AS {c}" for c in VALUE_COLS)},
       CAST(epoch(TIMESTAMP '{Q.fixtures.AS_OF_TIMESTAMP}') AS BIGINT) AS last_modified_s
FROM staging t JOIN (
  SELECT * FROM given WHERE o_orderkey IN (SELECT o_orderkey FROM given GROUP BY 1 HAVING count(*) = 1)
) p ON t.o_orderkey = p.o_orderkey"""),
        "json_out": _with(LAKE, """
SELECT o_orderkey, md5('{' || '"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus
  || '","o_totalprice":' || o_totalprice || ',"o_orderdate":"' || o_orderdate || '","o_orderpriority":"' || o_orderpriority
  || '","o_clerk":"' || o_clerk || '","o_shippriority":' || o_shippriority || ',"o_comment":"' || o_comment || '"}') AS record_md5
FROM lake"""),
        "missing_table_page": "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE false",
        "delete_from_lake": _with(DELETE_KEYS, "SELECT * FROM lake WHERE o_orderkey NOT IN (SELECT o_orderkey FROM delete_keys)"),
        "patch_update": _patched_state(),
        "patch_outcomes": _with(PATCHES, """
SELECT o_orderkey, 'applied' AS outcome FROM given WHERE o_orderkey IN (SELECT o_orderkey FROM staging)
UNION ALL SELECT o_orderkey, 'not_found' AS outcome FROM given WHERE o_orderkey NOT IN (SELECT o_orderkey FROM staging)
UNION ALL SELECT o_orderkey, 'no_fields' AS outcome FROM no_fields"""),
        "delete_by_key": _with(DELETE_KEYS, "SELECT * FROM staging WHERE o_orderkey NOT IN (SELECT o_orderkey FROM delete_keys)"),
        "delete_outcomes": _with(DELETE_KEYS, """
SELECT DISTINCT o_orderkey, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM staging) THEN 'deleted' ELSE 'not_found' END AS outcome
FROM delete_keys"""),
        "seed_new_rows": _with(SEED, "SELECT * FROM new_rows"),
        "seed_counts": _with(SEED, """
SELECT (SELECT count(*) FROM new_rows) AS seeded, (SELECT count(*) FROM candidates) AS attempted"""),
        "seed_result": _with(SEED, "SELECT * FROM staging UNION ALL SELECT * FROM new_rows"),
        "fill_defaults": _with(STAGING, f"""
SELECT {", ".join(f"COALESCE(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE {c} END, {defaults[c]}) AS {c}"
                  if c in blank else (f"COALESCE({c}, {defaults[c]}) AS {c}" if c in defaults else c) for c in COLS)}
FROM staging"""),
        "key_violations": """
SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
        "key_violation_summary": "\nUNION ALL\n".join(_count_sql(t, TPCH_KEYS[t], t) for t in CLONE_TABLES),
        "length_violations": _with(RECORDS, "\nUNION ALL\n".join(
            f"SELECT '{c}' AS column_name, {n} AS max_length, count(*) FILTER (WHERE length({c}) > {n}) AS n_violations FROM records"
            for c, n in ORDERS.lengths.items())),
        "sync_final_state": _with(MERGED, "SELECT * FROM merged"),
        "sync_final_state_buckets": _with(MERGED, "SELECT * FROM merged"),
        "sync_two_checkpoints": _with(MERGED, "SELECT * FROM merged"),
        "sync_final_state_log": _with(MERGED, "SELECT * FROM merged"),
        "backfill_with_changes": _with(MERGED, "SELECT * FROM merged"),
        "snapshot_changes": _with(MERGED, f"""
SELECT {_cols("m.")}, CASE WHEN t.o_orderkey IS NULL THEN 'I' ELSE 'U' END AS change
FROM (SELECT * FROM merged WHERE o_orderkey % 70 != 0) m LEFT JOIN lake t ON t.o_orderkey = m.o_orderkey
WHERE t.o_orderkey IS NULL OR {" OR ".join(f"t.{c} IS DISTINCT FROM m.{c}" for c in VALUE_COLS)}
UNION ALL
SELECT o_orderkey, {", ".join(f"NULL AS {c}" for c in VALUE_COLS)}, 'D' AS change FROM lake WHERE o_orderkey % 70 = 0"""),
        "sync_row_counts": "\nUNION ALL\n".join(_synced_count(t) for t in CLONE_TABLES),
        "page_synced_customers": f"""
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM (
  SELECT * FROM customer WHERE c_custkey % 10 != 3
  UNION ALL
  SELECT * REPLACE (c_custkey + (SELECT max(c_custkey) + 1 FROM customer) AS c_custkey) FROM customer WHERE c_custkey % 10 = 0
) c ORDER BY c_custkey LIMIT {Q.CUSTOMER_LIMIT} OFFSET {Q.CUSTOMER_OFFSET}""",
    }
