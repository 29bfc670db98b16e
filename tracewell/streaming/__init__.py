"""Structured Streaming forms of the recorder and of the windowed operators."""
