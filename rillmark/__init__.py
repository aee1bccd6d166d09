"""Rillmark: a PySpark-native text retrieval and corpus engine."""
