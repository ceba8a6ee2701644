"""Ingest of manifests as they arrive."""
