"""Survival analytics for repeated-census panels, as Spark DataFrame jobs."""
