"""Spark-first analytics: point/mesh geometry, catalogue queries and training-data operators."""
