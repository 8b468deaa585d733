"""Streaming of the sliced dataset engine."""
