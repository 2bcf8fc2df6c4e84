"""Structured Streaming forms of log ingest, correlation and monitoring."""
