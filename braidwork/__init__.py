"""Spark-native analytics over conversations and documents."""
