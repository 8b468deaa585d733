"""Sources of the sliced dataset engine."""
