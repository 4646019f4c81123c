"""Spark-native audit of automated decisions about tabular metadata."""
