"""loomline: a PySpark-native engine for parallel text and corpus preparation."""

__version__ = "0.1.0"
