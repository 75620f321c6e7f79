"""Spark-native analytics for networks of places and scheduled services."""
