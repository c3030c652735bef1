"""Sources of the embedding engine."""
