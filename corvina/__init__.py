"""Corvina: analytics on Spark DataFrames (relational, ordered, text, graph, vector and statistics operators)."""
