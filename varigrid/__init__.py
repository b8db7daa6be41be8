"""Variant analytics on Spark: one analysis under many settings, compared, tracked and reused."""
