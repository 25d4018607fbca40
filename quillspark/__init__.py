"""Spark-native engine for document intake analytics."""
