"""Governed named queries and end-to-end jobs."""
