"""Composed queries and their ANSI SQL twins."""
