"""Spark-native reduction of on/off time-series traces: every step is a DataFrame plan."""
