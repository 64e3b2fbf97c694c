"""Typed object analytics on PySpark DataFrames."""
