"""Spark-native engine for recorded workout and sensor time-series at fleet scale."""

__version__ = "0.1.0"
