"""Composed jobs, query registry and the matching check SQL."""
