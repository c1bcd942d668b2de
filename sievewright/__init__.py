"""Spark-native corpus curation and research analytics."""
