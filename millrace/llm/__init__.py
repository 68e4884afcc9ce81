"""Operators for texts and names of training data. Nothing else in the library imports this package."""
