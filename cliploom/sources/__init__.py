"""Readers, writers and ingest operators."""
