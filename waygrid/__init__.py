"""Spark-native analytics on transport networks."""
