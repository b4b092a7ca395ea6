"""Ranked-lineage analytics and sequence assignment on PySpark DataFrames."""
