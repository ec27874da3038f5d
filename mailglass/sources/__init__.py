"""Readers, writers and snapshot dimension tables."""
