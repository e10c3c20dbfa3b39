"""Column expressions: JVM-side scalar functions."""
