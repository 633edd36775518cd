"""Incremental fact load and idempotent totals with Structured Streaming."""
