"""Spark-native analytics over market bars, fills, events and reference tables."""
