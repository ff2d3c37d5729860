"""Spark-native document retrieval, evaluation and corpus preparation."""
