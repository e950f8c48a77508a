"""Spark-native analytics over corpora of sectioned documents."""
