"""Readers, mappings, ingestion and exports."""
