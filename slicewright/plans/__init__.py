"""Plans of the sliced dataset engine."""
