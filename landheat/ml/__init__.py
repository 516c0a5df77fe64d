"""Training and evaluation with Spark ML."""
