"""Spark-native analytics over property tables."""
