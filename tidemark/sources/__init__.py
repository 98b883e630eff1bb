"""Readers, writers and payload formats."""
