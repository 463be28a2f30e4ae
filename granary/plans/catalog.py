"""All queries of the library, and their comparison SQL."""

from __future__ import annotations

import importlib

MODULES = ("keys_text", "dedup", "mixing", "scoring", "sequences", "jobs", "adapted", "solved", "streams")


def _entries() -> dict[str, tuple]:
    out: dict[str, tuple] = {}
    for m in MODULES:
        out |= importlib.import_module(f"{__package__}.{m}").Q
    return out


def queries() -> dict:
    return {name: f for name, (f, _) in _entries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _entries().items() if sql}
