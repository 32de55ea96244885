"""Scalar column functions: text, hashing, paths, names."""
