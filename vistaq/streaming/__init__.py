"""Structured Streaming counterparts of the ingestion flows."""
