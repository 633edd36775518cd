"""Readers of landed data, the table store (append, overwrite, upserts) and ingest."""
