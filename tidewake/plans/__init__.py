"""Plans of the marine engine."""
