"""Structured Streaming forms of the ingest, rollup, dedup and session operators."""
