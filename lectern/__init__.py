"""Spark-first analytics for question banks, lesson summaries and text corpora."""
