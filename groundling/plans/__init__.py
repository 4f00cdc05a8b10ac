"""Logical plans: the derived inputs of the queries and the composed article pipeline."""
