"""Tapeloom: recorded-session analytics as Spark DataFrame jobs."""
