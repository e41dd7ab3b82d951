"""Compositions of operators: corpus preparation, training runs, query registry."""
