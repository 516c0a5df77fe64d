"""Operators for preparing training data, each a set of Spark jobs over plain DataFrames."""
