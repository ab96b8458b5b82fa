"""Readers of landed responses and documents, and sinks for review files."""
