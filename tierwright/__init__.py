"""Tiered-processing analytics as Spark DataFrame and SQL plans."""
