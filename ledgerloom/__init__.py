"""Spark-native analytics for accounting journals."""
