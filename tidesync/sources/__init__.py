"""Sources and sinks: lake tables, JSON records, JDBC, derived change batches."""
