"""Registered queries: name → (Spark callable, SQL text or None)."""

from importlib import import_module

MODULES = ["ops", "finance", "intake", "docs", "ledger", "governance", "io"]


def all_entries() -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(import_module(f"registry.{name}").ENTRIES)
    return out
