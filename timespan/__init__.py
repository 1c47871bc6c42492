"""Timed-text and interval analytics on PySpark DataFrames."""
