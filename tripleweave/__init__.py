"""Graph-shaped data on Spark: triples in, graph patterns out, every step a DataFrame."""
