"""Readers, writers and the catalogue of sources."""
