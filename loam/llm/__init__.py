"""Operators for building training data at scale.  Nothing else in loam imports this package."""
