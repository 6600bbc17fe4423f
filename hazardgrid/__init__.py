"""Spatial risk analytics on PySpark."""
