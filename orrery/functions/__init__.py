"""Scalar and row-wise expression builders."""
