"""Structured Streaming forms of the page operators (an extension)."""
