"""Readers, writers and table catalogues."""
