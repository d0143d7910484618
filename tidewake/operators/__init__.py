"""Operators of the marine engine."""
