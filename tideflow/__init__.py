"""Spark-native analytics for daily money-flow series."""
