"""Geospatial and corpus analytics on PySpark."""
