"""Readers, writers, derived hypothesis relations and run configuration."""
