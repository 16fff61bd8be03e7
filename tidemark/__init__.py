"""Spark-native quantitative analytics engine."""
