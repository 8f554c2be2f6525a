"""Relational, graph and iterative operators over DataFrames."""
