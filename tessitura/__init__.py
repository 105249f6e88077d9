"""Spark-native analytics for listening histories and similar event logs."""
