"""Spark-native analytics over the data behind an enterprise assistant portal."""
