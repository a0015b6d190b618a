"""Spark-side sources of recorded sessions."""
