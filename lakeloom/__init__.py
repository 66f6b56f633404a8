"""Lakeloom: a PySpark-native analytics engine built from plain DataFrame operators."""
