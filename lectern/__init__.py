"""Lectern: document analytics on PySpark DataFrames."""
