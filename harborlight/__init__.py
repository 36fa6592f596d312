"""Harborlight: a Spark-native engine for maritime contact analytics."""
