"""Spark-side streaming of recorded sessions."""
