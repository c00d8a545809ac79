"""Spark-native pattern analytics."""
