"""Scalar and array functions over columns."""
