"""Readers, writers and the registries of sources and contrasts."""
