"""Spark-native analytics for media-library catalogues."""
