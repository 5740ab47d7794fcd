"""Spark-native formulaic factor research engine."""
