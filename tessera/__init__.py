"""Multiresolution array analytics and corpus preparation on PySpark DataFrames."""
