"""Readers, writers and catalogue maintenance."""
