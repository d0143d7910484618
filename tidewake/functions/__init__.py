"""Functions of the marine engine."""
