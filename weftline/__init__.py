"""Weighted-relation analytics and incremental view maintenance on PySpark."""
