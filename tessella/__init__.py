"""Tessella: a PySpark-native analytics engine for collections of short technical texts."""

__version__ = "0.1.0"
