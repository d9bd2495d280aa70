"""Spark-native analytics over an inspection graph, telemetry and review texts."""

__version__ = "0.1.0"
