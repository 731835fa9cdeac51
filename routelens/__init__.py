"""Spark-native analytics for choosing between strategies per item, and training-data operators."""
