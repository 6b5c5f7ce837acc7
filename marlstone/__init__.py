"""Spark-native evidence engine for corpora of files and their change history."""
