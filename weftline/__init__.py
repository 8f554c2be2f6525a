"""Relational, graph and iterative analytics expressed on PySpark DataFrames."""
