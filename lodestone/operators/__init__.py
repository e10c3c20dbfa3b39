"""Relational, graph, retrieval and scoring operators (DataFrame in, DataFrame out)."""
