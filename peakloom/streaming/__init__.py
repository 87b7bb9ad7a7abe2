"""Ingestion of peak lists as they arrive."""
