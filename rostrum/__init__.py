"""Rostrum: a PySpark-native analytics engine for attributed text."""

__version__ = "0.1.0"
