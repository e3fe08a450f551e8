"""Structured Streaming jobs over the same feature definitions as batch."""
