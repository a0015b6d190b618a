"""Spark-side functions of recorded sessions."""
