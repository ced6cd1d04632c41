"""Skein: a PySpark-native analytics engine for text corpora and model-evaluation results."""

__version__ = "0.1.0"
