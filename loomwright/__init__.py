"""Spark-native curation and scoring of function-calling corpora."""
