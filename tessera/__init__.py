"""Tessera: a PySpark-native engine for bi-temporal, tiered memory data."""
