"""Structured Streaming forms of prediction ingest, tallies, grading and failure watch."""
