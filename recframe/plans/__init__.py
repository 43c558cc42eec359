"""Compositions of operators (recommendation, training data, reports)."""
