"""Variant analytics on Spark: expansion, condensing, cohort questions and synthetic samples."""
