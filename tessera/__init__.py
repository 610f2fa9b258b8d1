"""Spark-native context retrieval, memory analytics and corpus engine."""
