"""Spark-native operators for time-indexed, multimodal episode tables."""
