"""Siltstone: a Spark-native engine for knowledge retrieval and event analytics."""

__version__ = "0.1.0"
