"""Operators for training data made of texts; nothing else in the library imports this package."""
