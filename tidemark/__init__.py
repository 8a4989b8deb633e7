"""Event-log and incremental-discovery analytics on PySpark."""
