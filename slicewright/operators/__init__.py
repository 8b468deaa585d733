"""Operators of the sliced dataset engine."""
