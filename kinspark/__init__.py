"""Spark-native lineage analytics over collections of numeric tensors."""
