"""Spark-native analytics for property graphs drawn from source code."""
