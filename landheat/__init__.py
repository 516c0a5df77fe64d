"""Spark-native land-surface-temperature analytics, and a training-data toolbox beside it."""
