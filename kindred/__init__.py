"""Kindred: entity resolution and corpus preparation on PySpark DataFrames."""
