"""Pipelines made of the operators, and the queries that the driver registers."""
