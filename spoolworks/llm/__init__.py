"""Operators for training data: sampling to targets, linkage, term counts, encoding, leak and span search."""
