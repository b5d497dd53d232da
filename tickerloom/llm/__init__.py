"""Operators for training data: search, mixing, PII, language, scoring, extraction, duplicates, pieces."""
