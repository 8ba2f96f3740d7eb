"""Operators for preparing training data at scale. Nothing else in inkgrid imports this package."""
