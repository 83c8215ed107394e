"""Structured Streaming over growing transcript files."""
