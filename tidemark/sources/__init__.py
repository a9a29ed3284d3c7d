"""Readers, writers and the adapters that turn event tables into an archive."""
