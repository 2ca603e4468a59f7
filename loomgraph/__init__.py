"""Spark-native graph recommendation engine."""
