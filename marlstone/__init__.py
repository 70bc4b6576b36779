"""Spark-native analytics: event-driven time series, cross-validation and evaluation operators."""
