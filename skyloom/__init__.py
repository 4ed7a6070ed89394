"""Spark-native analytics for dense, time-indexed recorder data."""
