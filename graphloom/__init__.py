"""A Spark-native knowledge-graph engine for network data models."""
