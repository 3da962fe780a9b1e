"""Spark-native evidence retrieval, grounding and evaluation engine."""
