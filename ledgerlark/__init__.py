"""Spark-first engine for building, validating, scoring and comparing evaluation data."""
