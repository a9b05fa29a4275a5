"""Corvane: a PySpark-native analytics engine for embedding-centred media catalogs."""

__version__ = "0.1.0"
