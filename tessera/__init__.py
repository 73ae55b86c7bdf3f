"""Tessera: evidence, typed columns and profiling for tables, as Spark DataFrame steps."""
