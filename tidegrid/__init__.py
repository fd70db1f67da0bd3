"""Spark-native screening, review and corpus analytics."""
