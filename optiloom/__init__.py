"""Spark-native analytics for the results of optimization runs."""
