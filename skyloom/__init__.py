"""Spark-native detection of thin co-moving structures in star catalogues."""

__version__ = "0.2.0"
