"""Spark-native catalogue resolution: names, votes, titles, genres and action plans as DataFrames."""
