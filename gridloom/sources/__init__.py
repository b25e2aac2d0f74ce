"""Readers, writers and publication."""
