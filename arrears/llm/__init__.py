"""Operators of a training-data pipeline. Nothing outside this package
imports it; its queries are added by ``__spark_entry__`` when present."""
