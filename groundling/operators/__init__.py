"""Operators of the grounded-text engine, each with its query and the SQL that checks it."""
