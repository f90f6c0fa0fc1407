"""Spark-native tokenization and corpus analytics."""
