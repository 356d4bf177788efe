"""lexmill: a PySpark-native engine for legal-style document corpora."""

__version__ = "0.1.0"
