"""Schemas, readers, writers and the derived sample tables."""
