"""Scalar functions: built from column expressions, so they stay in generated code."""
