"""Spark-side operators of recorded sessions."""
