"""Structured Streaming forms of the inbox, review state and run statistics."""
