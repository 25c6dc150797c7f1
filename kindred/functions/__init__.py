"""Scalar, array and hash functions."""
