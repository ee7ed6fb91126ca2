"""Spark-native analytics over corpora of code and text."""
