"""Coincidence search over paired streams, as PySpark DataFrame transformations."""
