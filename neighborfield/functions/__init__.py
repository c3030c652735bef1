"""Functions of the embedding engine."""
