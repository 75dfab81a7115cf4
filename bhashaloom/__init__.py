"""Spark-native preparation and analysis of multilingual text corpora."""
