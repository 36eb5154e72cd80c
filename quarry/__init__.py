"""Spark-native analytics over packaged binary assets."""
