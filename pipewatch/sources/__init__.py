"""Readers, writers and the adapters over the driver tables."""
