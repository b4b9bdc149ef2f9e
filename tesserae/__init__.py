"""Tesserae: a PySpark-native engine for code search, evidence assembly and corpus preparation."""

__version__ = "0.1.0"
