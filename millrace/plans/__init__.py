"""Pipeline compilation, execution and the query catalogue."""
