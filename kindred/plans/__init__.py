"""Registered queries with their SQL, and plan helpers."""
