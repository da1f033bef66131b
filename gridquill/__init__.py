"""Spark-native hazard-exposure and evidence analytics on DataFrames."""
