"""A PySpark-native engine for photogrammetric geometry and for preparing text corpora."""

__version__ = "0.1.0"
