"""Spark-native retail demand analytics: panels, features, segments, forecasts, metrics and serving tables."""
