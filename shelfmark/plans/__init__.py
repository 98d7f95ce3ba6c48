"""Compositions of the operators: strategies, search, hybrid, evaluation."""
