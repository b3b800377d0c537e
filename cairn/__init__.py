"""Cairn: a Spark-native content index and retrieval-evaluation engine."""
