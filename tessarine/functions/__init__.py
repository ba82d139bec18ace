"""Scalar text and similarity functions."""
