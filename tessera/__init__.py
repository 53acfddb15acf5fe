"""Spark-native analytics over document corpora, graphs and vector spaces."""
