"""Distributed operators: products, objectives, prefix sums, metrics, splits, curves."""
