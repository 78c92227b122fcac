"""Spark-native engine for episode datasets."""
