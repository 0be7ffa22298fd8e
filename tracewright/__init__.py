"""Spark-native analytics for web-navigation agent traces."""
