"""Structured Streaming forms of the stateless line operators."""
