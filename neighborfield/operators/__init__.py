"""Operators of the embedding engine."""
