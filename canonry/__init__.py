"""Spark-native entity resolution, canonical-layer queries and corpus tools."""
