"""Relational, graph, vector, text and scoring operators: DataFrames in, a DataFrame out."""
