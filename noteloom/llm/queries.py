"""All queries of this subpackage and their SQL; ``__spark_entry__.py`` adds them if it can import this."""

from __future__ import annotations

import importlib

MODULES = ("terms", "lookalike", "pairs", "sentences", "pii", "mapping", "tokens", "packing", "residue")


def _gathered(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"noteloom.llm.{name}"), what, {})
    return found


def queries() -> dict:
    return _gathered("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gathered("ORACLE")
