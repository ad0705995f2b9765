"""Spark-native analytics for bibliographic and full-text collections."""
