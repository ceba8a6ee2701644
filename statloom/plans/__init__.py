"""Whole commands (ingest, export) and the queries checked against SQL."""
