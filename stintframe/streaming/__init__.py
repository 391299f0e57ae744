"""Ingest and scoring on streams."""
