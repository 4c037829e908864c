"""Plumbline: a Spark-native engine for dated policy communications and macro series."""

__version__ = "0.1.0"
