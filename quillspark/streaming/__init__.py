"""Structured Streaming over append-only history logs (an extension)."""
