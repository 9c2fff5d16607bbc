"""Concurrency analytics and corpus preparation on PySpark DataFrames."""
