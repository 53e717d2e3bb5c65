"""Structured Streaming jobs over the capture folder."""
