"""Slicewright: a sliced, append-only dataset engine expressed as DataFrame plans."""

__version__ = "0.1.0"
