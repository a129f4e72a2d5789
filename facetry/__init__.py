"""Spark-native engine for vector-search test data."""
