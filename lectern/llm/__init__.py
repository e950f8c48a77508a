"""Operators for building training data: each one a Spark job over whole tables."""
