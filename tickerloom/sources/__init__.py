"""Landed files in, result files out."""
