"""Plans of the embedding engine."""
