"""The queries of the engine and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["motion", "terrain", "search", "world", "recovery", "lost", "roads"]


def queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= import_module(f".{m}", __package__).Q
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for m in MODULES:
        out |= import_module(f".{m}", __package__).SQL
    return out
