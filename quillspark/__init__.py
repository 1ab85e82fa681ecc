"""Spark-native corpus building, retrieval and world-store analytics."""

__version__ = "0.1.0"
