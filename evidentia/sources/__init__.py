"""Readers and writers for manifests, dossiers, documents, indexes and events."""
