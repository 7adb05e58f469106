"""Readers, writers and reference rows."""
