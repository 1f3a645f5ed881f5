"""A lineage engine for Spark: run a query once, then ask which input rows are behind its output rows."""
