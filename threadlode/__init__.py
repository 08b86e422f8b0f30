"""Spark-native analytics over personal conversation history."""
