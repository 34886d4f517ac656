"""Spark-native building blocks for wide business-contact and document tables."""
