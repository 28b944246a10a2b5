"""Tessera: Spark-native analytics over tables, panels and time series."""
