"""Operators for large-scale training-data pipelines; nothing else in the library imports them."""
