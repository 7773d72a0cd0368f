"""Operators for training-data pipelines; optional, used by nothing in the core."""
