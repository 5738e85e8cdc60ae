"""Spark-native equity factor and event analytics."""
