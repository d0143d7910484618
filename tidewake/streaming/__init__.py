"""Streaming of the marine engine."""
