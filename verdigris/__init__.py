"""Verdigris: a Spark-native engine for decision data and its evaluation."""

__version__ = "0.1.0"
