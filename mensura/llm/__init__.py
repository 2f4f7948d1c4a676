"""Operators for training data: fusion, leakage, neighbours, splits, clusters, packing, text quality."""
