"""Spark-native analytics over identity-card reads."""
