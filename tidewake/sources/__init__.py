"""Sources of the marine engine."""
