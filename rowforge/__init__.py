"""Spark-native engine for evaluation tables and training-data preparation."""
