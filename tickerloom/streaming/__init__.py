"""Incremental cleaning of a landing folder."""
