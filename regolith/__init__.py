"""Spark-native analytics for national product registers."""
