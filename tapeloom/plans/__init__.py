"""Spark-side plans of recorded sessions."""
