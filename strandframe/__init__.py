"""Spark-first analytics for sequence, interval, alignment and text tables."""
