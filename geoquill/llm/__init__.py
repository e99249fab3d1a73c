"""Operators for training-data pipelines; optional, nothing else in the library imports them."""
