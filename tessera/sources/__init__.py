"""Readers, writers and ingest steps."""
