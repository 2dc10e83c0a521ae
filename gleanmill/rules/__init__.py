"""Ordered rules that give every row a verdict and the reason for it."""
