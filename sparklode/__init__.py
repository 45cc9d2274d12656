"""Spark-native context retrieval and call-graph analytics."""
