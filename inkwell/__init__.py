"""Spark-first text analytics and retrieval over document collections."""
