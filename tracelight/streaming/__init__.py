"""Streaming forms of the window, de-duplication and chain operators."""
