"""Structured Streaming forms of the stateful and monitoring operators."""
