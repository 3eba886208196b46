"""Spark-native analytics over technical prose."""
