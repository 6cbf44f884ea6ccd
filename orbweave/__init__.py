"""Spark-native analytics over nested lifetime facts, and a training-data toolkit."""
