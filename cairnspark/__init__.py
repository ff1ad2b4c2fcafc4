"""Spark-native analytics on located, grouped and dated tables, and corpus operators in ``llm``."""
