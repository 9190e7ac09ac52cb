"""Ingestion flows and the engine that ties the operators together."""
