"""Spark-native analytics over compiled code: decode binaries into tables, then query them as DataFrames."""
