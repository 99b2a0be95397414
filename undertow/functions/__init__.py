"""Scalar functions that queries share."""
