"""Readers, writers and the catalog table."""
