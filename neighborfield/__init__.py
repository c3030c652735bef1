"""Stochastic-neighbour graph embedding and sparse-matrix analytics as DataFrame plans."""
