"""Spark-native terrain and raster analytics."""
