"""Registered queries, their input tables and their SQL checks."""

from __future__ import annotations

from importlib import import_module


def all_queries() -> dict[str, tuple]:
    """name -> (query, SQL check or None)."""
    out: dict[str, tuple] = {}
    for part in ("line_queries", "text_queries", "flow_queries", "finding_queries"):
        out.update(import_module(f"registry.{part}").QUERIES)
    return out
