"""tidesync: keep keyed tables in step and apply changes to them, on Spark.

Modules:
  contracts   table contracts (types, key, lengths, defaults)
  functions/  column expressions (search predicate, casts, patch fallback, defaults)
  sources/    lake tables, JSON record ingest, JDBC scans and appends, derived change batches
  operators/  typed load and checks, search / count / pages, key joins, MERGE and other DML
  plans/      jobs: snapshot clone, publish by location swap, forward merge, registered queries
  streaming/  continuous keyed sync with Structured Streaming
"""

from tidesync.contracts import ORDERS, ORDERS_STAGING, TPCH_KEYS, TableContract

__all__ = ["ORDERS", "ORDERS_STAGING", "TPCH_KEYS", "TableContract"]
