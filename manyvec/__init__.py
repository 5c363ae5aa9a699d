"""manyvec: a PySpark-native engine for multi-vector retrieval analytics."""

__version__ = "0.1.0"
