"""Spark-native engine for forecast-robustness analytics over time-series panels."""
