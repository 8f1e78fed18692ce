"""Readers and sinks for landed files."""
