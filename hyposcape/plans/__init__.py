"""Composite flows built from the operators."""
