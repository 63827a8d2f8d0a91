"""Spark-native Chinese text normalisation and encoding repair."""
