"""Spark-native blocks for sequencing and mass-spectrometry data."""
