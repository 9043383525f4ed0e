"""Spark-native content-signature analytics."""
