"""Spark-native quality monitoring of map data."""
