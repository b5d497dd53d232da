"""The registered queries and, beside each, the SQL that must give the same rows."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["label_queries", "text_queries", "chunk_queries", "document_queries", "lookup_queries", "fundamental_queries"]


def _merged(name: str) -> dict:
    merged: dict = {}
    for module in _MODULES:
        for key, value in getattr(import_module(f"{__name__}.{module}"), name).items():
            if key in merged:
                raise ValueError(f"{key} is registered twice")
            merged[key] = value
    return merged


def all_queries() -> dict:
    return _merged("QUERIES")


def all_sql() -> dict:
    return _merged("SQL")
