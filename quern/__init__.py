"""Spark-native key/value analytics."""
