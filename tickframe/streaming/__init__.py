"""Structured Streaming versions of ingest, windowed figures and alerts."""
