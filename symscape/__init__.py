"""Symscape: a Spark-first analytics engine over source-code symbols."""
