"""Readers and parsers of posting sources."""
