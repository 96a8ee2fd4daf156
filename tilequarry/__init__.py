"""Spark-native engine for visual-pattern search and box analytics over very large rasters."""
