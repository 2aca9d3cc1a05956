"""Spark-native association analytics and training-data operators."""
