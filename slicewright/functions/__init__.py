"""Functions of the sliced dataset engine."""
