"""Structured Streaming over scan logs (an extension: the batch operators do the same without a stream)."""
