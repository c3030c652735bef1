"""Streaming of the embedding engine."""
