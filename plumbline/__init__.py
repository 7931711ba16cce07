"""Integrity analytics for datasets, models and inference streams as plain Spark DataFrame operators."""
