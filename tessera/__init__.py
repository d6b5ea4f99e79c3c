"""Tessera: a Spark-first analytics engine for legacy-system modernization data."""
