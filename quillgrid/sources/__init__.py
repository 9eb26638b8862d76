"""Readers, writers and their formats."""
