"""Whole pipelines: compositions of operators, lazy until a sink asks."""
